"""Daily volume and publisher-day batches over a stream of postings (entity, publisher, ts); on bounded input they equal the batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_volume(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Postings of every entity and day; rows later than delay are dropped by the watermark."""
    days = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "entity").agg(F.count("*").alias("postings"))
    return days.select("entity", F.to_date("window.start").alias("day"), "postings")


def batches(stream: DataFrame, min_batch: int = 3, delay: str = "1 day") -> DataFrame:
    """Publisher-days with at least min_batch postings of an entity."""
    days = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "entity", "publisher").agg(F.count("*").alias("postings"))
    return days.filter(F.col("postings") >= min_batch).select("entity", "publisher", F.to_date("window.start").alias("day"), "postings")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Runs of a publisher's postings without a pause of gap."""
    s = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "publisher").agg(F.count("*").alias("postings"))
    return s.select("publisher", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "postings")
