"""Items of postings: frequency, coverage, co-occurrence, half-year trends and their stratified verdicts, for every entity.

Postings are one row an id, items one row a posting and item (roles.py): so postings with an item are counted as rows, without a distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions.periods import half_of, key_of, start_of
from postmeter.functions.stats import ratio
from postmeter.roles import EXCLUDED_SEGMENTS


def long_table(postings: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each posting and item, with the posting's entity, publisher, segment and day."""
    return items.join(postings.select("id", "entity", "publisher", "segment", "day"), "id")


def eligible(postings: DataFrame, excluded=EXCLUDED_SEGMENTS) -> DataFrame:
    """Postings outside the excluded segments; a null segment is kept."""
    return postings.filter(~F.coalesce(F.col("segment").isin(*excluded), F.lit(False)))


def denominator(postings: DataFrame) -> DataFrame:
    """Postings that may be a denominator of item shares: with items, outside the excluded segments."""
    return eligible(postings).filter("has_item")


def counted(postings: DataFrame, items: DataFrame) -> DataFrame:
    """A long table whose rows that are alike, by entity, segment, month and item, stand as one row with their number, copies; day is the month's first.

    It is as long as there are such cells, however many postings there are, and stands for items wherever only shares by entity, segment and half are asked."""
    kept = postings.select("id", "entity", "segment", "has_item", F.trunc("day", "month").alias("day"))
    return items.join(kept, "id").groupBy("entity", "segment", "has_item", "day", "item", "item_group").agg(F.count("*").alias("copies"))


def tally(df: DataFrame, when: Column | None = None) -> Column:
    """How many items df's rows (those for which when holds) stand for: rows, or their copies where df is counted."""
    if "copies" in df.columns:
        return F.coalesce(F.sum("copies" if when is None else F.when(when, F.col("copies"))), F.lit(0))
    return F.count("*") if when is None else F.count(F.when(when, 1))


def of_base(items: DataFrame, base: DataFrame, *columns: str) -> DataFrame:
    """items of the denominator postings base, with base's columns. A counted table has them already."""
    return denominator(items) if "copies" in items.columns else items.join(base.select("id", *columns), "id")


def frequency(postings: DataFrame, long: DataFrame) -> DataFrame:
    """Postings with each item, as shares of those with items and of all, and the rank from the most frequent."""
    totals = postings.groupBy("entity").agg(F.count("*").alias("n_all"), F.count(F.when(F.col("has_item"), 1)).alias("n_skilled"))
    n = long.groupBy("entity", "item", "item_group").agg(F.count("id").alias("postings")).join(totals, "entity")
    rank = F.rank().over(Window.partitionBy("entity").orderBy(F.desc("postings")))
    return n.select("entity", "item", "item_group", "postings", (F.col("postings") / F.greatest("n_skilled", F.lit(1))).alias("share_of_skilled"), (F.col("postings") / F.greatest("n_all", F.lit(1))).alias("share_of_all"), rank.alias("rank"))


def coverage(postings: DataFrame, items: DataFrame, period: str = "month") -> DataFrame:
    """Postings, those with items, their share and the mean number of items where there are any, for every period."""
    per = items.groupBy("id").agg(F.count("*").alias("k"))
    joined = postings.join(per, "id", "left").withColumn("start", start_of(F.col("day"), period))
    out = joined.groupBy("entity", "start").agg(F.count("*").alias("postings"), F.count(F.when(F.col("has_item"), 1)).alias("postings_with_items"), F.avg(F.when(F.col("k") > 0, F.col("k"))).alias("mean_items_when_present"))
    return out.withColumn("coverage", F.col("postings_with_items") / F.col("postings"))


def by_period(postings: DataFrame, items: DataFrame, period: str = "month") -> DataFrame:
    """Item frequency of every period over both denominators."""
    cover = coverage(postings, items, period).select("entity", "start", "postings", "postings_with_items")
    n = long_table(postings, items).withColumn("start", start_of(F.col("day"), period)).groupBy("entity", "start", "item", "item_group").agg(F.count("id").alias("n_postings"))
    out = n.join(cover, ["entity", "start"], "left")
    return out.select("entity", key_of(F.col("start"), period).alias("period"), "item", "item_group", "n_postings", "postings_with_items", ratio(F.col("n_postings"), F.col("postings_with_items")).alias("share_of_skilled"), ratio(F.col("n_postings"), F.col("postings")).alias("share_of_all"))


def cooccurrence(long: DataFrame, min_pairs: int = 5) -> DataFrame:
    """Unordered item pairs of a posting with their Jaccard overlap, at least min_pairs times together.

    Pairs are formed inside a posting, whose items are few; totals come from one aggregate of the long table.
    """
    one = long.select("entity", "id", "item")
    totals = one.groupBy("entity", "item").agg(F.count("*").alias("n"))
    a, b = one.withColumnRenamed("item", "item_a"), one.withColumnRenamed("item", "item_b")
    both = a.join(b, ["entity", "id"]).filter("item_a < item_b").groupBy("entity", "item_a", "item_b").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= min_pairs)
    out = both.join(totals.select("entity", F.col("item").alias("item_a"), F.col("n").alias("n_a")), ["entity", "item_a"])
    out = out.join(totals.select("entity", F.col("item").alias("item_b"), F.col("n").alias("n_b")), ["entity", "item_b"])
    return out.withColumn("jaccard", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")))


def _halves(df: DataFrame, value) -> list:
    half = half_of(F.col("day"))
    return [value(half == h).alias(f"n_{h}") for h in ("h1", "h2")]


def trend(postings: DataFrame, long: DataFrame, min_postings: int = 10, threshold: float = 0.25) -> DataFrame:
    """Half-year shares of postings with items, and emerging, declining or stable by relative change, with a floor of support."""
    d = postings.groupBy("entity").agg(*_halves(postings, lambda c: F.count(F.when(c & F.col("has_item"), 1))))
    d = d.withColumnsRenamed({"n_h1": "d1", "n_h2": "d2"}).filter("d1 > 0 and d2 > 0")
    out = long.groupBy("entity", "item", "item_group").agg(*_halves(long, lambda c: tally(long, c))).join(d, "entity")
    out = out.withColumns({"share_h1": F.round(F.col("n_h1") / F.col("d1"), 4), "share_h2": F.round(F.col("n_h2") / F.col("d2"), 4)})
    out = out.withColumn("delta", F.round(F.col("share_h2") - F.col("share_h1"), 4)).withColumn("relative_change", F.round(ratio(F.col("delta"), F.col("share_h1")), 3))
    r = F.col("relative_change")
    flag = F.when(F.col("n_h1") + F.col("n_h2") < min_postings, "insufficient_support").when(r >= threshold, "emerging").when(r <= -threshold, "declining").otherwise("stable")
    return out.drop("d1", "d2").withColumn("flag", flag)


def matrix(long: DataFrame, items: list[str]) -> DataFrame:
    """Postings by the named items, 0 or 1. The list of columns is explicit, so no extra pass finds it."""
    return long.groupBy("entity", "id").agg(*(F.max((F.col("item") == i).cast("int")).alias(f"item_{i.replace(' ', '_')}") for i in items))


def velocity(postings: DataFrame, items: DataFrame, period: str = "month", min_postings: int = 10) -> DataFrame:
    """Share of postings with items outside the excluded segments, for every period and item; support counts over all periods."""
    kept = eligible(postings).withColumn("start", start_of(F.col("day"), period))
    d = kept.groupBy("entity", "start").agg(F.count(F.when(F.col("has_item"), 1)).alias("postings_with_items"))
    n = items.join(kept.select("id", "entity", "start"), "id").groupBy("entity", "start", "item", "item_group").agg(F.count("id").alias("n_postings"))
    out = n.join(d, ["entity", "start"], "left")
    support = F.sum("n_postings").over(Window.partitionBy("entity", "item"))
    return out.select("entity", key_of(F.col("start"), period).alias("period"), "item", "item_group", "n_postings", "postings_with_items", ratio(F.col("n_postings"), F.col("postings_with_items")).alias("share_of_skilled"), (support >= min_postings).alias("meets_support"))


def trend_within_segment(postings: DataFrame, long: DataFrame, min_postings: int = 10) -> DataFrame:
    """Half-year item shares inside each segment."""
    kept = eligible(postings).filter("segment is not null")
    d = kept.groupBy("entity", "segment").agg(*_halves(kept, lambda c: F.count(F.when(c & F.col("has_item"), 1)))).withColumnsRenamed({"n_h1": "denom_h1", "n_h2": "denom_h2"})
    n = eligible(long).groupBy("entity", "segment", "item").agg(*_halves(long, lambda c: tally(long, c)))
    out = n.join(d, ["entity", "segment"])
    out = out.withColumns({"share_h1": F.round(ratio(F.col("n_h1"), F.col("denom_h1")), 4), "share_h2": F.round(ratio(F.col("n_h2"), F.col("denom_h2")), 4)})
    return out.withColumns({"share_delta": F.round(F.col("share_h2") - F.col("share_h1"), 4), "meets_support": F.col("n_h1") + F.col("n_h2") >= min_postings})


def stratified_verdict(within: DataFrame, min_segments: int = 2) -> DataFrame:
    """For every item: does it move one way in enough supported segments, and never the other way?"""
    use = F.col("meets_support") & F.col("share_delta").isNotNull()
    out = within.groupBy("entity", "item").agg(F.count(F.when(use & (F.col("share_delta") > 0), 1)).alias("up"), F.count(F.when(use & (F.col("share_delta") < 0), 1)).alias("down"), F.count(F.when(use, 1)).alias("n_segments"))
    up, down, n = F.col("up"), F.col("down"), F.col("n_segments")
    verdict = F.when(n == 0, "insufficient_support").when((up >= min_segments) & (down == 0), "rising_in_all_segments").when((down >= min_segments) & (up == 0), "falling_in_all_segments").when(n < min_segments, "insufficient_support").otherwise("mix_dependent")
    return out.withColumn("verdict", verdict)


def pooled_against_strata(trends: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pooled direction of each item beside its stratified verdict; reversed where strata all move the other way."""
    pooled = trends.withColumn("pooled_direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat"))
    out = pooled.select("entity", "item", F.col("delta").alias("pooled_delta"), "pooled_direction").join(verdicts, ["entity", "item"])
    opposite = ((F.col("pooled_direction") == "up") & (F.col("verdict") == "falling_in_all_segments")) | ((F.col("pooled_direction") == "down") & (F.col("verdict") == "rising_in_all_segments"))
    return out.withColumn("status", F.when(opposite, "reversed").when(F.col("verdict") == "insufficient_support", "unsupported").otherwise(""))


def by_segment_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("entity", "item", "segment").agg(F.count("id").alias("postings"))


def emerging_per_posting(long: DataFrame, trends: DataFrame) -> DataFrame:
    """Number of emerging items of every posting that has items."""
    flagged = trends.filter("flag = 'emerging'").select("entity", "item", F.lit(1).alias("is_emerging"))
    return long.join(flagged, ["entity", "item"], "left").groupBy("entity", "id").agg(F.count("is_emerging").alias("n_emerging"))


def rare(long: DataFrame, at_most: int = 10) -> DataFrame:
    """Items that at most so many postings of an entity have."""
    return long.groupBy("entity", "item").agg(F.count("id").alias("postings")).filter(F.col("postings") <= at_most)
