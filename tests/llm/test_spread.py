"""Joins in which one key holds nearly all rows, and passages that many documents and items share."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmeter.llm import common, decontaminate


def test_one_key_of_nearly_all_rows(spark):
    """100,000 rows on one key: equal to a join, and no task reads more than its part."""
    left = spark.range(100_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), "id")
    right = spark.createDataFrame([(-1, "a"), (-1, "b"), (0, "c"), (50, "d"), (7, "e")], "k long, v string")
    got = common.spread_join(left, right, "k", ["id"], most=5_000)
    want = left.join(right, "k")
    assert got.columns == ["k", "id", "v"] and got.count() == want.count() and got.exceptAll(want).isEmpty()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = common.spread_join(left, right, "k", ["id"], most=5_000).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert tasks < 60_000  # two rows of right for each of 98,000 left ones: a plain join has them all in one task
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_null_keys_and_empty_tables(spark):
    left = spark.createDataFrame([(None, 1), (2, 2)], "k long, id long")
    right = spark.createDataFrame([(None, "x"), (2, "y")], "k long, v string")
    assert [tuple(r) for r in common.spread_join(left, right, "k", ["id"], most=1).collect()] == [(2, 2, "y")]
    assert common.spread_join(left.limit(0), right, "k", ["id"]).count() == 0 and common.spread_join(left, right.limit(0), "k", ["id"]).count() == 0


@pytest.mark.parametrize("most", [3, 100_000])
def test_a_passage_of_many_items_and_documents(spark, monkeypatch, most):
    """One passage begins every item and stands in most documents; every item is found in every such document, under all its ids."""
    spread = common.spread_join
    monkeypatch.setattr(decontaminate, "spread_join", lambda *a: spread(*a, most=most))
    passage = " ".join(f"shared{k}" for k in range(14))
    items = [(i, f"{passage} own{i} tail{i}") for i in range(12)] + [(100, f"{passage} own3 tail3"), (101, "nowhere to be found " * 6), (None, passage), (102, None)]
    docs = [(d, f"before {d} {passage} after {d}") for d in range(40)] + [(50, "nothing of it"), (51, None), (None, passage)]
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    every = ",".join(map(str, [*range(12), 100]))
    assert got == {**{d: every for d in range(40)}, 50: "", 51: "", None: every}
    assert Counter(got.values())[every] == 41
