"""Exact order statistics of cells of any size: no cell is sorted in one task.

Equal values are counted first, so a value that stands millions of times is one row. Values are dealt out by range over cell and value; every
range knows how many values of its cells stand in the ranges before it, and so the place of each of its own. What is asked of a cell, its median or
any list of places, is read from the rows that hold these places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmeter.sources.tables import settled


def runs(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """*by, value, part, first, count, n: every distinct value of a cell, the place (from 0) at which it first stands among the cell's sorted
    values, how often it stands, the range it was dealt to, and the size of the cell. Null values are left out, null cells are cells."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("count"))
    ranged = settled(counted.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()))
    # A row a cell and range: as many as there are ranges for the largest cell.
    sizes = ranged.groupBy(*by, "part").agg(F.sum("count").alias("size"))
    cell = Window.partitionBy(*by)
    before = F.sum("size").over(cell.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = sizes.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("part").alias("_part"), before.alias("before"), F.sum("size").over(cell).alias("n"))
    same = (F.col("part") == F.col("_part")) & F.expr(" and ".join(f"`{c}` <=> `_{c}`" for c in by) or "true")
    inside = Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn("upto", F.sum("count").over(inside)).join(placed, same)
    return out.select(*by, value, "part", (F.col("before") + F.col("upto") - F.col("count")).alias("first"), "count", "n")


def medians(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """*by, n, m: size and exact median (mean of the two middle values of an even cell) of every cell."""
    middle = lambda k: (F.col("first") <= k) & (k < F.col("first") + F.col("count"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    held = runs(df, by, value).filter(middle(low) | middle(high))
    return held.groupBy(*by, "n").agg(((F.min(value) + F.max(value)) / 2).alias("m"))


def values_at(held: DataFrame, wanted: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """*by, k, value for every distinct (*by, k) of wanted: the value at place k of its cell. held: what runs() returned.

    A place finds its range by the ranges' spans, and its value as the last run of that range that begins at or before it."""
    spans = held.groupBy(*by, "part").agg(F.min("first").alias("lo"), F.max(F.col("first") + F.col("count")).alias("hi"))
    asked = wanted.select(*by, "k").distinct().join(spans, by).filter((F.col("lo") <= F.col("k")) & (F.col("k") < F.col("hi")))
    kind = held.schema[value].dataType
    events = held.select(*by, "part", F.col("first").alias("k"), F.lit(0).alias("asks"), F.col(value)).unionByName(asked.select(*by, "part", "k", F.lit(1).alias("asks"), F.lit(None).cast(kind).alias(value)))
    so_far = Window.partitionBy(*by, "part").orderBy("k", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(value, F.last(value, ignorenulls=True).over(so_far)).filter("asks = 1").select(*by, "k", value)
