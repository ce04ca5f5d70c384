"""Postings are joined and redrawn once: counted tables and patterns give what postings and items give, and no plan draws or joins again."""

import datetime

import pytest

from postmeter.operators import compare, items, similarity


@pytest.fixture(scope="module")
def tables(spark):
    day = datetime.date
    p = [(k, "ab"[k % 2], "x", day(1995 + k % 3, 1 + k % 12, 1 + k % 28), (None, "1-URGENT", "5-LOW", "2-HIGH")[k % 4], k % 7 != 3, None) for k in range(400)]
    postings = spark.createDataFrame([*p, (400, "c", "x", None, "2-HIGH", True, None)], "id long, entity string, publisher string, day date, segment string, has_item boolean, value double")
    held = [(k, f"item {j}", f"group {j % 2}") for k in range(401) for j in range(6) if (k * 7 + j * j) % 5 < 2]
    return postings, spark.createDataFrame(held, "id long, item string, item_group string")


def rows(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=str)


def test_counts_stand_for_items(tables):
    p, i = tables
    long, per = items.long_table(p, i), items.counted(p, i)
    wanted = compare.top_items(compare.item_share(p, i), 4)
    assert rows(compare.item_share(p, per)) == rows(compare.item_share(p, i))
    assert rows(similarity.profiles(p, per)) == rows(similarity.profiles(p, i))
    assert rows(items.trend(p, per)) == rows(items.trend(p, long))
    assert rows(items.trend_within_segment(p, per)) == rows(items.trend_within_segment(p, long))
    assert rows(compare.within_stratum(p, per, wanted)) == rows(compare.within_stratum(p, i, wanted))


def test_patterns_hold_the_profile(tables):
    p, i = tables
    assert rows(similarity.pattern_profile(p, similarity.posting_patterns(p, i))) == rows(similarity.profiles(p, i))


def test_postings_are_redrawn_once(tables):
    p, i = tables
    for found in (similarity.bootstrap(p, i, 5), similarity.cluster_support(p, i, (2,), 5)):
        assert " MapInPandas" not in found._jdf.queryExecution().toString()
    boot = similarity.bootstrap(p, i, 5).collect()
    assert {(r.entity_a, r.entity_b) for r in boot} == {("a", "b"), ("a", "c"), ("b", "c")} and all(r.draws == 5 for r in boot)


def test_the_ledger_reads_written_postings(spark, small):
    from postmeter import roles
    from postmeter.plans import ledger
    from postmeter.sources.tables import settled

    share, trend = ledger.volume_and_share(settled(roles.order_postings(spark, small)))
    assert share.count() == trend.count() == 5
