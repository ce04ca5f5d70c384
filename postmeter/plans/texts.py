"""Disclosed values and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmeter import roles
from postmeter.functions import vocabulary as V
from postmeter.operators import compare, text, values
from postmeter.plans.comparison import RELATIVE, RELATIVE_BY
from postmeter.plans.registry import POSTINGS, query


def _postings(spark, d):
    return roles.order_postings(spark, d)


@query(
    "values_disclosure",
    f"""WITH {POSTINGS}, a AS (SELECT entity, segment, row_number() OVER (PARTITION BY entity ORDER BY n DESC, segment) AS r, n / sum(n) OVER (PARTITION BY entity)::DOUBLE AS s FROM (SELECT entity, segment, count(*) AS n FROM postings GROUP BY ALL)),
b AS (SELECT entity, segment, row_number() OVER (PARTITION BY entity ORDER BY n DESC, segment) AS r, n / sum(n) OVER (PARTITION BY entity)::DOUBLE AS s FROM (SELECT entity, segment, count(*) AS n FROM postings WHERE value IS NOT NULL GROUP BY ALL)),
g AS (SELECT entity, count(*) AS postings, count(value) AS disclosed, count(DISTINCT publisher) FILTER (value IS NOT NULL) AS publishers_disclosing FROM postings GROUP BY 1)
SELECT g.entity, postings, disclosed, publishers_disclosing, a.segment AS modal_all, round(a.s, 6) AS modal_share_all, b.segment AS modal_disclosed, round(b.s, 6) AS modal_share_disclosed, round(disclosed / postings::DOUBLE, 6) AS disclosed_share, round(100 * (b.s - a.s), 6) AS shift_pp FROM g LEFT JOIN a ON a.entity = g.entity AND a.r = 1 LEFT JOIN b ON b.entity = g.entity AND b.r = 1""",
)
def disclosure(spark, d):
    return values.disclosure(_postings(spark, d))


@query("values_disclosure_by_publisher", f"WITH {POSTINGS} SELECT publisher, count(*) AS postings, count(value) AS disclosed, round(count(value) / count(*)::DOUBLE, 6) AS disclosed_share FROM postings GROUP BY 1")
def by_publisher(spark, d):
    return values.disclosure_by_publisher(_postings(spark, d))


@query("values_feasible_cells", f"WITH {POSTINGS}, c AS (SELECT publisher, entity FROM postings WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) SELECT publisher, count(*) AS entities, string_agg(entity, ', ' ORDER BY entity) AS names, count(*) * (count(*) - 1) // 2 AS pairs FROM c GROUP BY 1")
def feasible(spark, d):
    return values.feasible_cells(_postings(spark, d))


def _medians(by: str) -> str:
    on = " AND ".join(f"a.{c} = b.{c}" for c in by.split(", "))
    return f"WITH {POSTINGS}, c AS (SELECT {by}, entity, count(*) AS n, median(value) AS m FROM postings WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) SELECT {', '.join('a.' + c for c in by.split(', '))}, a.entity AS entity_a, b.entity AS entity_b, a.n AS n_a, b.n AS n_b, round(a.m, 6) AS median_a, round(b.m, 6) AS median_b, round(a.m - b.m, 6) AS difference FROM c a JOIN c b ON {on} AND a.entity < b.entity"


@query("values_pair_medians", _medians("publisher"))
def pair_medians(spark, d):
    return values.pair_medians(_postings(spark, d))


@query("values_pair_medians_by_segment", _medians("segment"))
def pair_medians_segment(spark, d):
    return values.pair_medians(_postings(spark, d), ("segment",))


@query("values_pairs_stratified")
def pairs_stratified(spark, d):
    return values.stratified_pairs(_postings(spark, d), n_boot=400)


@query("values_verdict")
def value_verdict(spark, d):
    p = _postings(spark, d)
    pairs = values.pair_intervals(p, values.pair_medians(p), 400)
    return values.value_verdict(values.disclosure(p), values.feasible_cells(p), pairs, values.stratified_pairs(p, n_boot=400))


@query("values_pair_intervals")
def pair_intervals(spark, d):
    p = _postings(spark, d)
    return values.pair_intervals(p, values.pair_medians(p))


FLOORS = """fl AS (SELECT b.entity, v.f AS floor, count(*) FILTER (least(b.h1_postings, b.h2_postings) >= v.f) AS tested, count(*) FILTER (least(b.h1_postings, b.h2_postings) >= v.f AND sign(b.log_share_change) = sign(r.log_share_change)) AS agreeing FROM relby b JOIN relative r USING (entity) CROSS JOIN (VALUES (0), (3), (5), (10)) v(f) GROUP BY ALL)"""


@query("values_cell_floors", f"WITH {POSTINGS}, {RELATIVE}, {RELATIVE_BY}, {FLOORS}, t AS (SELECT *, greatest(agreeing, tested - agreeing) AS m FROM fl) SELECT entity, CAST(floor AS BIGINT) AS floor, tested, agreeing, tested > 0 AND tested = agreeing AS confirmed, CASE WHEN tested > 0 THEN round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(m, tested + 1), lambda k: factorial(tested::INT)::DOUBLE / (factorial(k::INT)::DOUBLE * factorial((tested - k)::INT)::DOUBLE))) / pow(2.0::DOUBLE, tested)), 6) END AS p_value FROM t")
def cell_floors(spark, d):
    p = _postings(spark, d)
    return values.cell_floors(compare.relative_share_by_publisher(p), compare.relative_share(p))


@query(
    "values_floor_dependence",
    f"""WITH {POSTINGS}, {RELATIVE}, {RELATIVE_BY}, {FLOORS}, t AS (SELECT *, tested > 0 AND tested = agreeing AS confirmed FROM fl), g AS (SELECT entity, coalesce(string_agg(floor::VARCHAR, ', ' ORDER BY floor) FILTER (confirmed), '') AS floors_confirmed, count(*) AS n, count(*) FILTER (confirmed) AS c,
 arg_min(tested, floor) AS first_tested, arg_max(tested, floor) AS last_tested, arg_min(confirmed, floor) AS first_confirmed FROM t GROUP BY 1)
SELECT entity, floors_confirmed, n AS floors_tested, c > 0 AND c < n AS floor_dependent, c > 0 AND c < n AND NOT first_confirmed AND last_tested < first_tested AS gained_by_dropping_tests FROM g""",
)
def floor_dependence(spark, d):
    p = _postings(spark, d)
    return values.floor_dependence(values.cell_floors(compare.relative_share_by_publisher(p), compare.relative_share(p)))


@query("text_clean_pages")
def clean_pages(spark, d):
    cleaned = roles.read(spark, d, "pages").select("page_id", text.clean(F.col("html")).alias("cleaned"))
    return cleaned.withColumn("token_count", F.size(text.tokens(F.col("cleaned"))))


@query("text_stable_id", "SELECT page_id, 'page-' || left(sha1(coalesce(url, '') || '|' || page_id::VARCHAR), 12) AS stable_id FROM pages")
def stable_id(spark, d):
    return roles.read(spark, d, "pages").select("page_id", text.stable_id(F.lit("page"), F.col("url"), F.col("page_id").cast("string")).alias("stable_id"))


_LITERALS = ", ".join(f"'{t}'" for t in V.TECH_LITERALS)
_SHORT = ", ".join(f"'{t}'" for t in V.SHORT_TECH_TOKENS)
_STOP = ", ".join(f"'{t}'" for t in V.STOPWORDS)
TOKENS = f"""list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '(?:{text.TOKEN})'), lambda w: CASE WHEN w IN ({_LITERALS}) THEN w ELSE trim(w, '._-/') END),
 lambda w: (w IN ({_LITERALS}) OR length(w) >= 3 OR w IN ({_SHORT})) AND w NOT IN ({_STOP}))"""


@query("text_token_count_conversations", f"SELECT conv_id, turn, len({TOKENS}) AS n_tokens FROM conversations")
def token_count(spark, d):
    c = roles.read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query("text_slug_parts", "SELECT DISTINCT p_name AS name, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slug_parts(spark, d):
    return roles.read(spark, d, "part").select(F.col("p_name").alias("name"), text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug")).distinct()
