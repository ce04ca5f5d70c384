"""Item tables and half-year item trends."""

from __future__ import annotations

from postmeter import roles
from postmeter.operators import items
from postmeter.sources.tables import settled
from postmeter.plans.registry import ELIGIBLE, ITEMS, POSTINGS, query

ALL_ITEMS = f"{POSTINGS}, {ITEMS}"


def bound(spark, d):
    """(postings, items, long). Both tables are settled, as their joins and the distinct items serve several branches of a plan."""
    p, i = settled(roles.order_postings(spark, d)), settled(roles.order_items(spark, d))
    return p, i, items.long_table(p, i)


@query("items_long_table", f"WITH {ALL_ITEMS} SELECT id, item, item_group, entity, publisher, segment, day FROM long")
def long_table(spark, d):
    return bound(spark, d)[2]


TOTALS = "tot AS (SELECT entity, count(*) AS n_all, count(*) FILTER (has_item) AS n_skilled FROM postings GROUP BY 1)"


@query(
    "items_frequency",
    f"""WITH {ALL_ITEMS}, {TOTALS}, n AS (SELECT entity, item, item_group, count(DISTINCT id) AS postings FROM long GROUP BY ALL)
SELECT entity, item, item_group, postings, round(postings / greatest(n_skilled, 1)::DOUBLE, 6) AS share_of_skilled, round(postings / greatest(n_all, 1)::DOUBLE, 6) AS share_of_all, rank() OVER (PARTITION BY entity ORDER BY postings DESC) AS rank FROM n JOIN tot USING (entity)""",
)
def frequency(spark, d):
    p, _, long = bound(spark, d)
    return items.frequency(p, long)


COVER = """per AS (SELECT id, count(*) AS k FROM items GROUP BY 1),
cover AS (SELECT entity, CAST(date_trunc('month', day) AS DATE) AS start, count(*) AS postings, count(*) FILTER (has_item) AS postings_with_items, avg(k) FILTER (k > 0) AS mean_items_when_present FROM postings LEFT JOIN per USING (id) GROUP BY ALL)"""


@query("items_coverage", f"WITH {ALL_ITEMS}, {COVER} SELECT entity, start, postings, postings_with_items, round(mean_items_when_present, 6) AS mean_items_when_present, round(postings_with_items / postings::DOUBLE, 6) AS coverage FROM cover")
def coverage(spark, d):
    p, i, _ = bound(spark, d)
    return items.coverage(p, i)


@query(
    "items_by_period",
    f"""WITH {ALL_ITEMS}, {COVER}, n AS (SELECT entity, CAST(date_trunc('month', day) AS DATE) AS start, item, item_group, count(DISTINCT id) AS n_postings FROM long GROUP BY ALL)
SELECT entity, strftime(start, '%Y-%m') AS period, item, item_group, n_postings, postings_with_items, round(n_postings / nullif(postings_with_items, 0)::DOUBLE, 6) AS share_of_skilled, round(n_postings / nullif(postings, 0)::DOUBLE, 6) AS share_of_all FROM n LEFT JOIN cover USING (entity, start)""",
)
def by_period(spark, d):
    p, i, _ = bound(spark, d)
    return items.by_period(p, i)


@query(
    "items_cooccurrence",
    f"""WITH {ALL_ITEMS}, one AS (SELECT DISTINCT entity, id, item FROM long), t AS (SELECT entity, item, count(*) AS n FROM one GROUP BY ALL),
b AS (SELECT a.entity, a.item AS item_a, b.item AS item_b, count(*) AS n_both FROM one a JOIN one b ON a.entity = b.entity AND a.id = b.id AND a.item < b.item GROUP BY ALL HAVING count(*) >= 5)
SELECT b.entity, item_a, item_b, n_both, x.n AS n_a, y.n AS n_b, round(n_both / (x.n + y.n - n_both)::DOUBLE, 6) AS jaccard FROM b JOIN t x ON x.entity = b.entity AND x.item = item_a JOIN t y ON y.entity = b.entity AND y.item = item_b""",
)
def cooccurrence(spark, d):
    return items.cooccurrence(items.long_table(roles.order_postings(spark, d), roles.order_items(spark, d)))


HALF = "count(DISTINCT id) FILTER (month(day) <= 6) AS n_h1, count(DISTINCT id) FILTER (month(day) > 6) AS n_h2"
TREND = f"""dn AS (SELECT entity, count(*) FILTER (has_item AND month(day) <= 6) AS d1, count(*) FILTER (has_item AND month(day) > 6) AS d2 FROM postings GROUP BY 1),
tr0 AS (SELECT entity, item, item_group, {HALF} FROM long GROUP BY ALL),
tr1 AS (SELECT tr0.*, round(n_h1 / d1::DOUBLE, 4) AS share_h1, round(n_h2 / d2::DOUBLE, 4) AS share_h2 FROM tr0 JOIN dn USING (entity) WHERE d1 > 0 AND d2 > 0),
tr2 AS (SELECT *, round(share_h2 - share_h1, 4) AS delta FROM tr1),
tr3 AS (SELECT *, round(delta / nullif(share_h1, 0), 3) AS relative_change FROM tr2),
trend AS (SELECT *, CASE WHEN n_h1 + n_h2 < 10 THEN 'insufficient_support' WHEN relative_change >= 0.25 THEN 'emerging' WHEN relative_change <= -0.25 THEN 'declining' ELSE 'stable' END AS flag FROM tr3)"""


@query("items_trend", f"WITH {ALL_ITEMS}, {TREND} SELECT * FROM trend")
def trend(spark, d):
    p, _, long = bound(spark, d)
    return items.trend(p, long)


WIDE = ["red gear", "blue bolt", "small ring", "hot anvil"]


@query("items_matrix", f"WITH {ALL_ITEMS} SELECT entity, id, " + ", ".join(f"CAST(max(CASE WHEN item = '{i}' THEN 1 ELSE 0 END) AS BIGINT) AS item_{i.replace(' ', '_')}" for i in WIDE) + " FROM long GROUP BY ALL")
def matrix(spark, d):
    return items.matrix(bound(spark, d)[2], WIDE)


@query(
    "items_velocity",
    f"""WITH {ALL_ITEMS}, {ELIGIBLE}, dd AS (SELECT entity, date_trunc('month', day) AS start, count(*) FILTER (has_item) AS postings_with_items FROM eligible GROUP BY ALL),
n AS (SELECT entity, date_trunc('month', day) AS start, item, item_group, count(DISTINCT id) AS n_postings FROM items JOIN eligible USING (id) GROUP BY ALL)
SELECT entity, strftime(start, '%Y-%m') AS period, item, item_group, n_postings, postings_with_items, round(n_postings / nullif(postings_with_items, 0)::DOUBLE, 6) AS share_of_skilled, sum(n_postings) OVER (PARTITION BY entity, item) >= 10 AS meets_support FROM n LEFT JOIN dd USING (entity, start)""",
)
def velocity(spark, d):
    p, i, _ = bound(spark, d)
    return items.velocity(p, i)


WITHIN = f"""wd AS (SELECT entity, segment, count(*) FILTER (has_item AND month(day) <= 6) AS denom_h1, count(*) FILTER (has_item AND month(day) > 6) AS denom_h2 FROM eligible WHERE segment IS NOT NULL GROUP BY ALL),
wn AS (SELECT entity, segment, item, {HALF} FROM long WHERE coalesce(segment NOT IN ('5-LOW'), TRUE) GROUP BY ALL),
w1 AS (SELECT wn.*, denom_h1, denom_h2, round(n_h1 / nullif(denom_h1, 0)::DOUBLE, 4) AS share_h1, round(n_h2 / nullif(denom_h2, 0)::DOUBLE, 4) AS share_h2 FROM wn JOIN wd USING (entity, segment)),
within AS (SELECT *, round(share_h2 - share_h1, 4) AS share_delta, n_h1 + n_h2 >= 10 AS meets_support FROM w1)"""
STRATA = """sv0 AS (SELECT entity, item, count(*) FILTER (meets_support AND share_delta > 0) AS up, count(*) FILTER (meets_support AND share_delta < 0) AS down, count(*) FILTER (meets_support AND share_delta IS NOT NULL) AS n_segments FROM within GROUP BY ALL),
strata AS (SELECT *, CASE WHEN n_segments = 0 THEN 'insufficient_support' WHEN up >= 2 AND down = 0 THEN 'rising_in_all_segments' WHEN down >= 2 AND up = 0 THEN 'falling_in_all_segments' WHEN n_segments < 2 THEN 'insufficient_support' ELSE 'mix_dependent' END AS verdict FROM sv0)"""


@query("items_trend_within_segment", f"WITH {ALL_ITEMS}, {ELIGIBLE}, {WITHIN} SELECT * FROM within")
def within(spark, d):
    p, _, long = bound(spark, d)
    return items.trend_within_segment(p, long)


@query("items_stratified_verdict", f"WITH {ALL_ITEMS}, {ELIGIBLE}, {WITHIN}, {STRATA} SELECT * FROM strata")
def stratified(spark, d):
    p, _, long = bound(spark, d)
    return items.stratified_verdict(items.trend_within_segment(p, long))


@query(
    "items_pooled_against_strata",
    f"""WITH {ALL_ITEMS}, {ELIGIBLE}, {WITHIN}, {STRATA}, {TREND}, z AS (SELECT t.entity, t.item, delta AS pooled_delta, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS pooled_direction, up, down, n_segments, verdict FROM trend t JOIN strata s USING (entity, item))
SELECT *, CASE WHEN (pooled_direction = 'up' AND verdict = 'falling_in_all_segments') OR (pooled_direction = 'down' AND verdict = 'rising_in_all_segments') THEN 'reversed' WHEN verdict = 'insufficient_support' THEN 'unsupported' ELSE '' END AS status FROM z""",
)
def pooled(spark, d):
    p, _, long = bound(spark, d)
    return items.pooled_against_strata(items.trend(p, long), items.stratified_verdict(items.trend_within_segment(p, long)))


@query("items_by_segment_counts", f"WITH {ALL_ITEMS} SELECT entity, item, segment, count(DISTINCT id) AS postings FROM long GROUP BY ALL")
def by_segment(spark, d):
    return items.by_segment_counts(bound(spark, d)[2])


@query("items_emerging_per_posting", f"WITH {ALL_ITEMS}, {TREND} SELECT l.entity, l.id, count(t.item) AS n_emerging FROM long l LEFT JOIN trend t ON t.entity = l.entity AND t.item = l.item AND flag = 'emerging' GROUP BY ALL")
def emerging(spark, d):
    p, _, long = bound(spark, d)
    return items.emerging_per_posting(long, items.trend(p, long))


@query("items_rare", f"WITH {ALL_ITEMS} SELECT entity, item, count(DISTINCT id) AS postings FROM long GROUP BY ALL HAVING count(DISTINCT id) <= 180")
def rare(spark, d):
    return items.rare(bound(spark, d)[2], 180)
