"""Comparison between entities."""

from __future__ import annotations

from postmeter import roles
from postmeter.functions.stats import ERFC
from postmeter.operators import compare
from postmeter.plans.items import ALL_ITEMS, bound
from postmeter.plans.registry import COMMON, ELIGIBLE, ORACLE_SQL, POSTINGS, query
from postmeter.plans.trends import BALANCED, VERDICT
from postmeter.sources.tables import settled

#: Which adjective marks an entity's own items, and which marks items it originated.
OWN = {"AUTOMOBILE": "hot", "BUILDING": "red", "FURNITURE": "blue", "HOUSEHOLD": "small", "MACHINERY": "large"}
ORIGIN = {"AUTOMOBILE": "cold", "BUILDING": "old"}


def _postings(spark, d):
    return roles.order_postings(spark, d)


def vendors(spark, d):
    """entity, item, relation: the vendor dimension, derived from the part names."""
    from pyspark.sql import functions as F

    names = roles.read(spark, d, "part").select(F.col("p_name").alias("item")).distinct()
    rows = [F.struct(F.lit(e).alias("entity"), F.lit(a).alias("word"), F.lit(r).alias("relation")) for m, r in ((OWN, "own_product"), (ORIGIN, "origin")) for e, a in m.items()]
    return names.select("item", F.explode(F.array(*rows)).alias("v")).filter(F.col("item").startswith(F.concat(F.col("v.word"), F.lit(" ")))).select("v.entity", "item", "v.relation")


_VALUES = ", ".join(f"('{e}', '{a}', '{r}')" for m, r in ((OWN, "own_product"), (ORIGIN, "origin")) for e, a in m.items())
VENDORS = f"vendors AS (SELECT DISTINCT v.e AS entity, p_name AS item, v.r AS relation FROM part JOIN (VALUES {_VALUES}) v(e, a, r) ON p_name LIKE v.a || ' %')"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    k, n = f"({k})::DOUBLE", f"nullif(({n})::DOUBLE, 0)"
    z = "1.96::DOUBLE"
    p, dd = f"({k} / {n})", f"(1 + {z} * {z} / {n})"
    centre = f"(({p} + {z} * {z} / (2 * {n})) / {dd})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) / {dd})"
    return f"(CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, {centre} - {half}) END)", f"(CASE WHEN {n} > 0 THEN least(1.0::DOUBLE, {centre} + {half}) END)"


def newcombe_sql(k1, n1, k2, n2) -> tuple[str, str]:
    (l1, u1), (l2, u2) = wilson_sql(k1, n1), wilson_sql(k2, n2)
    p1, p2 = f"(({k1})::DOUBLE / ({n1}))", f"(({k2})::DOUBLE / ({n2}))"
    lo = f"(({p1} - {p2}) - sqrt(pow({p1} - {l1}, 2) + pow({u2} - {p2}, 2)))"
    hi = f"(({p1} - {p2}) + sqrt(pow({u1} - {p1}, 2) + pow({p2} - {l2}, 2)))"
    some = f"({n1}) > 0 AND ({n2}) > 0"
    return f"(CASE WHEN {some} THEN greatest(-1.0::DOUBLE, {lo}) END)", f"(CASE WHEN {some} THEN least(1.0::DOUBLE, {hi}) END)"


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + ({x}) / 2))"
    poly = "0.0::DOUBLE"
    for c in reversed(ERFC):
        poly = f"({c}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def two_p_sql(k1, n1, k2, n2) -> str:
    p = f"((({k1}) + ({k2}))::DOUBLE / (({n1}) + ({n2})))"
    se = f"sqrt({p} * (1 - {p}) * (1.0::DOUBLE / ({n1}) + 1.0::DOUBLE / ({n2})))"
    z = f"(abs(({k1})::DOUBLE / ({n1}) - ({k2})::DOUBLE / ({n2})) / nullif({se}, 0) / sqrt(2.0::DOUBLE))"
    return f"(CASE WHEN ({n1}) > 0 AND ({n2}) > 0 THEN CASE WHEN {se} = 0 THEN 1.0::DOUBLE ELSE {erfc_sql(z)} END END)"


def bh_sql(source: str, family: str, key: str, out: str) -> str:
    return f"""{out}_0 AS (SELECT *, p_value * count(p_value) OVER (PARTITION BY {family}) / row_number() OVER (PARTITION BY {family} ORDER BY p_value ASC NULLS LAST, {key}) AS scaled FROM {source}),
{out} AS (SELECT * EXCLUDE (scaled), CASE WHEN p_value IS NOT NULL THEN least(1.0::DOUBLE, min(scaled) OVER (PARTITION BY {family} ORDER BY p_value DESC NULLS FIRST, {key} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q_value FROM {out}_0)"""


@query("compare_common_publishers", f"WITH {POSTINGS}, {COMMON} SELECT * FROM common")
def common(spark, d):
    return compare.common_publishers(_postings(spark, d))


@query(
    "compare_common_panel",
    f"""WITH {POSTINGS}, {COMMON}, sz AS (SELECT entity, count(*) AS a FROM postings GROUP BY 1), c AS (SELECT entity, publisher, count(*) AS n, avg(has_item::INT) AS item_coverage FROM postings GROUP BY ALL)
SELECT sz.entity, common.publisher, coalesce(n, 0) AS postings, round(coalesce(n, 0) / a::DOUBLE, 6) AS share_of_entity, round(item_coverage, 6) AS item_coverage FROM sz CROSS JOIN common LEFT JOIN c ON c.entity = sz.entity AND c.publisher = common.publisher""",
)
def common_panel(spark, d):
    return compare.common_panel(_postings(spark, d))


BY_PERIOD = """bp AS (SELECT start, publisher FROM (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS start, publisher, entity FROM postings WHERE publisher IS NOT NULL) GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT entity) FROM postings)),
bps AS (SELECT start, count(*) AS n, string_agg(publisher, ', ' ORDER BY publisher) AS publishers FROM bp GROUP BY 1)"""


@query(
    "compare_common_panel_by_period",
    f"""WITH {POSTINGS}, {BY_PERIOD}, pr AS (SELECT CAST(date_trunc('month', day) AS DATE) AS start, count(DISTINCT entity) AS entities_present FROM postings GROUP BY 1)
SELECT strftime(pr.start, '%Y-%m') AS period, coalesce(n, 0) AS n_common_publishers, entities_present, coalesce(publishers, '') AS publishers FROM pr LEFT JOIN bps ON bps.start = pr.start""",
)
def by_period(spark, d):
    return compare.common_panel_by_period(_postings(spark, d))


RELATIVE = f"""{COMMON}, hv AS (SELECT entity, count(*) FILTER (month(day) <= 6) AS h1, count(*) FILTER (month(day) > 6) AS h2 FROM postings SEMI JOIN common USING (publisher) GROUP BY 1),
dn0 AS (SELECT e.entity, coalesce(h1, 0) AS h1, coalesce(h2, 0) AS h2 FROM (SELECT DISTINCT entity FROM postings) e LEFT JOIN hv USING (entity)),
dn1 AS (SELECT *, CAST(sum(h1) OVER () AS BIGINT) AS t1, CAST(sum(h2) OVER () AS BIGINT) AS t2, count(*) OVER () AS parts FROM dn0),
dn2 AS (SELECT *, round(h1 / nullif(t1, 0)::DOUBLE, 4) AS h1_share, round(h2 / nullif(t2, 0)::DOUBLE, 4) AS h2_share FROM dn1),
relative AS (SELECT entity, h1 AS h1_postings, h2 AS h2_postings, h1_share, h2_share, round((h2_share - h1_share) * 100, 2) AS share_change_pp,
  round(ln(((h2 + 0.5::DOUBLE) / (t2 + 0.5::DOUBLE * parts)) / ((h1 + 0.5::DOUBLE) / (t1 + 0.5::DOUBLE * parts))), 3) AS log_share_change, t1 AS panel_h1_total, t2 AS panel_h2_total FROM dn2)"""


@query("compare_relative_share_table", f"WITH {POSTINGS}, {RELATIVE} SELECT * FROM relative")
def relative(spark, d):
    return compare.relative_share(_postings(spark, d))


RELATIVE_BY = """rb0 AS (SELECT publisher, entity, count(*) FILTER (month(day) <= 6) AS h1, count(*) FILTER (month(day) > 6) AS h2 FROM postings SEMI JOIN common USING (publisher) GROUP BY ALL),
rb1 AS (SELECT *, CAST(sum(h1) OVER w AS BIGINT) AS t1, CAST(sum(h2) OVER w AS BIGINT) AS t2, count(*) OVER w AS parts FROM rb0 WINDOW w AS (PARTITION BY publisher)),
relby AS (SELECT publisher, entity, h1 AS h1_postings, h2 AS h2_postings, t1 AS publisher_h1_total, t2 AS publisher_h2_total, round(ln(((h2 + 0.5::DOUBLE) / (t2 + 0.5::DOUBLE * parts)) / ((h1 + 0.5::DOUBLE) / (t1 + 0.5::DOUBLE * parts))), 3) AS log_share_change FROM rb1 WHERE t1 >= 10 AND t2 >= 10)"""


@query("compare_relative_share_by_publisher", f"WITH {POSTINGS}, {COMMON}, {RELATIVE_BY} SELECT * FROM relby")
def relative_by(spark, d):
    return compare.relative_share_by_publisher(_postings(spark, d))


@query(
    "compare_relative_share_verdict",
    f"""WITH {POSTINGS}, {RELATIVE}, {RELATIVE_BY}, v AS (SELECT b.entity, r.log_share_change AS pooled, count(*) AS n, count(*) FILTER (sign(b.log_share_change) = sign(r.log_share_change)) AS agree FROM relby b JOIN relative r USING (entity) GROUP BY ALL)
SELECT entity, pooled AS pooled_log_share_change, n AS publishers_tested, agree AS publishers_agreeing, CASE WHEN agree = n THEN 'confirmed' WHEN agree > n / 2.0 THEN 'mixed' ELSE 'not supported' END AS verdict, CASE WHEN pooled > 0 THEN 'gaining share' WHEN pooled < 0 THEN 'losing share' ELSE 'flat' END AS direction FROM v""",
)
def relative_verdict(spark, d):
    p = _postings(spark, d)
    return compare.relative_share_verdict(compare.relative_share_by_publisher(p), compare.relative_share(p))


@query(
    "compare_half_over_half",
    f"""WITH {POSTINGS}, {BALANCED}, r AS (SELECT entity, count(*) FILTER (month(day) <= 6) AS raw_h1, count(*) FILTER (month(day) > 6) AS raw_h2 FROM postings GROUP BY 1), b AS (SELECT entity, count(*) FILTER (month(day) <= 6) AS b1, count(*) FILTER (month(day) > 6) AS b2 FROM onpanel GROUP BY 1),
j AS (SELECT entity, raw_h1, raw_h2, coalesce(b1, 0) AS balanced_h1, coalesce(b2, 0) AS balanced_h2 FROM r LEFT JOIN b USING (entity)), k AS (SELECT *, (raw_h2 / nullif(raw_h1, 0)::DOUBLE - 1) * 100 AS rc, (balanced_h2 / nullif(balanced_h1, 0)::DOUBLE - 1) * 100 AS bc FROM j)
SELECT entity, raw_h1, raw_h2, balanced_h1, balanced_h2, round(rc, 6) AS raw_pct_change, round(bc, 6) AS balanced_pct_change, coalesce(sign(rc) = sign(bc), FALSE) AS agrees FROM k""",
)
def half_over_half(spark, d):
    return compare.half_over_half(_postings(spark, d))


CELLS = """st AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS start FROM postings),
cells AS (SELECT s.start, e.entity, coalesce(n, 0) AS n FROM (SELECT DISTINCT start FROM st) s CROSS JOIN (SELECT DISTINCT entity FROM st) e LEFT JOIN (SELECT start, entity, count(*) AS n FROM st GROUP BY ALL) c ON c.start = s.start AND c.entity = e.entity)"""


@query(
    "compare_collection_artefacts",
    f"""WITH {POSTINGS}, {CELLS}, md AS (SELECT entity, median(n::DOUBLE) AS m FROM cells GROUP BY 1), pp AS (SELECT start, sum(n)::BIGINT AS postings, count(*) FILTER (n < m) AS below, count(*) AS ents FROM cells JOIN md USING (entity) GROUP BY 1),
q AS (SELECT pp.*, dp FROM pp JOIN (SELECT start, count(DISTINCT publisher) AS dp FROM st GROUP BY 1) USING (start))
SELECT strftime(start, '%Y-%m') AS period, postings, dp AS distinct_publishers, below AS entities_below_own_median, ents AS n_entities, round(postings / dp::DOUBLE, 6) AS postings_per_publisher, below >= ents - 1 AND dp < (SELECT median(dp::DOUBLE) FROM q) AS shared_thin_month FROM q""",
)
def artefacts(spark, d):
    return compare.collection_artefacts(_postings(spark, d))


@query("compare_entity_correlation", f"WITH {POSTINGS}, {CELLS} SELECT a.entity, b.entity AS other, round(corr(a.n, b.n), 6) AS r FROM cells a JOIN cells b USING (start) GROUP BY ALL")
def correlation(spark, d):
    return compare.entity_correlation(_postings(spark, d))


COMPARABLE = f"""{VERDICT}, {COMMON},
fl AS (SELECT p.*, panel.entity IS NOT NULL AS on_p, common.publisher IS NOT NULL AS on_c, coalesce(segment IN ('5-LOW'), FALSE) AS low FROM postings p LEFT JOIN panel ON panel.entity = p.entity AND panel.publisher = p.publisher LEFT JOIN common ON common.publisher = p.publisher),
ga AS (SELECT entity, count(*) AS postings, count(DISTINCT publisher) AS publishers, count(DISTINCT date_trunc('month', day)) AS months_observed, count(DISTINCT CASE WHEN on_p THEN publisher END) AS balanced_panel_publishers, avg(on_p::INT) AS balanced_panel_share,
  avg(on_c::INT) AS common_panel_share, avg(has_item::INT) AS item_coverage, avg(CASE WHEN NOT low THEN has_item::INT END) AS item_coverage_ex_excluded, avg(low::INT) AS excluded_share FROM fl GROUP BY 1),
tp AS (SELECT entity, publisher, n / sum(n) OVER (PARTITION BY entity)::DOUBLE AS s, row_number() OVER (PARTITION BY entity ORDER BY n DESC, publisher) AS pos_ FROM (SELECT entity, publisher, count(*) AS n FROM postings GROUP BY ALL)),
gate AS (SELECT ga.*, tp.publisher AS top_publisher, tp.s AS top_publisher_share, direction AS trend_direction, treatments_agree, common_panel_share >= 0.4 AS level_comparable FROM ga LEFT JOIN tp ON tp.entity = ga.entity AND pos_ = 1 LEFT JOIN verdict ON verdict.entity = ga.entity)"""


@query(
    "compare_comparability",
    f"""WITH {POSTINGS}, {COMPARABLE} SELECT * REPLACE (round(balanced_panel_share, 6) AS balanced_panel_share, round(common_panel_share, 6) AS common_panel_share, round(item_coverage, 6) AS item_coverage, round(item_coverage_ex_excluded, 6) AS item_coverage_ex_excluded, round(excluded_share, 6) AS excluded_share, round(top_publisher_share, 6) AS top_publisher_share) FROM gate""",
)
def comparability(spark, d):
    return compare.comparability(_postings(spark, d))


@query(
    "compare_level_verdict",
    f"""WITH {POSTINGS}, {COMMON}, g AS (SELECT entity, avg((publisher IN (SELECT publisher FROM common))::INT) AS s FROM postings GROUP BY 1), f AS (SELECT coalesce(string_agg(entity, ', ' ORDER BY entity) FILTER (s < 0.4), '') AS failing FROM g)
SELECT failing = '' AS identified, CASE WHEN failing = '' THEN 'all entities clear the common-panel floor' ELSE 'common-panel coverage below the floor for ' || failing END AS reason FROM f""",
)
def level_verdict(spark, d):
    return compare.level_verdict(compare.comparability(_postings(spark, d)))


MIX = "mx0 AS (SELECT entity, coalesce(segment, 'Unknown') AS segment, count(*) AS postings FROM postings GROUP BY ALL), mx AS (SELECT *, CAST(sum(postings) OVER (PARTITION BY entity) AS BIGINT) AS entity_postings, postings / sum(postings) OVER (PARTITION BY entity)::DOUBLE AS share FROM mx0)"
_lo, _hi = wilson_sql("postings", "entity_postings")


@query("compare_mix", f"WITH {POSTINGS}, {MIX} SELECT entity, segment, postings, entity_postings, round(share, 6) AS share, round({_lo}, 6) AS ci_low, round({_hi}, 6) AS ci_high FROM mx")
def mix(spark, d):
    return compare.mix(_postings(spark, d))


@query(
    "compare_mix_distance",
    f"""WITH {POSTINGS}, {MIX}, g AS (SELECT e.entity, s.segment, coalesce(share, 0) AS share FROM (SELECT DISTINCT entity FROM mx) e CROSS JOIN (SELECT DISTINCT segment FROM mx) s LEFT JOIN mx ON mx.entity = e.entity AND mx.segment = s.segment)
SELECT a.entity, b.entity AS other, round(sum(abs(a.share - b.share)) / 2, 6) AS distance FROM g a JOIN g b USING (segment) GROUP BY ALL""",
)
def mix_distance(spark, d):
    return compare.mix_distance(compare.mix(_postings(spark, d)))


def weights_sql(source: str, name: str = "wts") -> str:
    return f"{name} AS (SELECT segment, n / sum(n) OVER ()::DOUBLE AS weight FROM (SELECT coalesce(segment, 'Unknown') AS segment, count(*) AS n FROM {source} GROUP BY 1))"


@query("compare_pooled_weights", f"WITH {POSTINGS}, {weights_sql('postings')} SELECT segment, round(weight, 6) AS weight FROM wts")
def weights(spark, d):
    return compare.pooled_weights(_postings(spark, d))


STANDARD = "std AS (SELECT {by}, sum(k) / sum(n)::DOUBLE AS crude, sum(CASE WHEN n >= 10 THEN coalesce(weight, 0) * k / n END) / nullif(sum(CASE WHEN n >= 10 THEN coalesce(weight, 0) END), 0) AS standardised, coalesce(sum(CASE WHEN n >= 10 THEN coalesce(weight, 0) END), 0) AS weight_covered, count(*) FILTER (n >= 10) AS strata_used FROM cl LEFT JOIN wts USING (segment) GROUP BY ALL)"


@query(
    "compare_standardised_rate",
    f"""WITH {POSTINGS}, {weights_sql('postings')}, cl AS (SELECT entity, coalesce(segment, 'Unknown') AS segment, count(*) AS n, sum(has_item::INT)::DOUBLE AS k FROM postings GROUP BY ALL), {STANDARD.format(by='entity')}
SELECT entity, round(crude, 6) AS crude, round(weight_covered, 6) AS weight_covered, strata_used, round(standardised, 6) AS standardised, round(crude - standardised, 6) AS mix_effect FROM std""",
)
def standardised_rate(spark, d):
    return compare.standardised_rate(_postings(spark, d))


SHARE = f"""{ELIGIBLE}, ns AS (SELECT entity, count(*) AS n_skilled FROM base GROUP BY 1),
sh AS (SELECT entity, item, item_group, count(DISTINCT id) AS postings_with_item, any_value(n_skilled) AS n_skilled FROM items JOIN base USING (id) JOIN ns USING (entity) GROUP BY ALL)"""
_lo, _hi = wilson_sql("postings_with_item", "n_skilled")


@query("compare_item_share", f"WITH {ALL_ITEMS}, {SHARE} SELECT *, round(postings_with_item / n_skilled::DOUBLE, 6) AS share_of_skilled, round({_lo}, 6) AS ci_low, round({_hi}, 6) AS ci_high, postings_with_item >= 10 AS supported FROM sh")
def item_share(spark, d):
    p, i, _ = bound(spark, d)
    return compare.item_share(p, i)


DENSE = "dense AS (SELECT e.entity, e.n_skilled, s.item, s.item_group, coalesce(postings_with_item, 0) AS k FROM ns e CROSS JOIN (SELECT DISTINCT item, item_group FROM sh) s LEFT JOIN sh ON sh.entity = e.entity AND sh.item = s.item)"
_R = ("k", "n_skilled", "(ka - k)", "(na - n_skilled)")
_lo, _hi = newcombe_sql(*_R)
DISTINCT = f"""{SHARE}, {DENSE}, d1 AS (SELECT *, CAST(sum(k) OVER (PARTITION BY item) AS BIGINT) AS ka, (SELECT CAST(sum(n_skilled) AS BIGINT) FROM ns) AS na FROM dense),
d2 AS (SELECT entity, item, item_group, k AS postings_with_item, n_skilled, ka - k AS rest_with_item, na - n_skilled AS rest_n_skilled, k / n_skilled::DOUBLE AS share, (ka - k) / (na - n_skilled)::DOUBLE AS rest_share, k / n_skilled::DOUBLE - (ka - k) / (na - n_skilled)::DOUBLE AS diff,
 {_lo} AS diff_ci_low, {_hi} AS diff_ci_high, log2(((k + 0.5::DOUBLE) / (n_skilled + 1)) / ((ka - k + 0.5::DOUBLE) / (na - n_skilled + 1))) AS log_lift, {two_p_sql(*_R)} AS p_value, k >= 10 OR ka - k >= 10 AS supported FROM d1 WHERE ka > 0),
{bh_sql('d2', 'entity', 'item', 'dis')}"""
_ROUND = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query(
    "compare_distinctiveness",
    f"""WITH {ALL_ITEMS}, {VENDORS}, {DISTINCT} SELECT dis.* REPLACE ({_ROUND(['share', 'rest_share', 'diff', 'diff_ci_low', 'diff_ci_high', 'log_lift', 'p_value', 'q_value'])}), coalesce(q_value <= 0.05, FALSE) AND supported AS significant, coalesce(relation, '') AS vendor_relation, relation IS NOT NULL AS self_referential
FROM dis LEFT JOIN vendors USING (entity, item)""",
)
def distinctiveness(spark, d):
    p, i, _ = bound(spark, d)
    return compare.distinctiveness(settled(compare.item_share(p, i)), vendors(spark, d))


_P = ("ka", "na", "kb", "nb")
_lo, _hi = newcombe_sql(*_P)


@query(
    "compare_pairwise_gaps",
    f"""WITH {ALL_ITEMS}, {SHARE}, {DENSE}, pr AS (SELECT a.entity AS entity_a, b.entity AS entity_b, item, a.item_group, a.k AS ka, a.n_skilled AS na, b.k AS kb, b.n_skilled AS nb FROM dense a JOIN dense b USING (item) WHERE a.entity < b.entity AND greatest(a.k, b.k) >= 10),
p2 AS (SELECT *, ka / na::DOUBLE AS a_share, kb / nb::DOUBLE AS b_share, ka / na::DOUBLE - kb / nb::DOUBLE AS diff, round({_lo}, 4) AS ci_low, round({_hi}, 4) AS ci_high, {two_p_sql(*_P)} AS p_value FROM pr), {bh_sql('p2', 'entity_a, entity_b', 'item', 'gp')}
SELECT * REPLACE ({_ROUND(['a_share', 'b_share', 'diff', 'p_value', 'q_value'])}), coalesce(q_value <= 0.05, FALSE) AND (ci_low > 0 OR ci_high < 0) AS significant FROM gp""",
)
def pairwise(spark, d):
    p, i, _ = bound(spark, d)
    return compare.pairwise_gaps(settled(compare.item_share(p, i)))


@query(
    "compare_self_reference",
    f"""WITH {ALL_ITEMS}, {VENDORS}, ow AS (SELECT l.*, v.item IS NOT NULL AS own FROM long l LEFT JOIN vendors v ON v.entity = l.entity AND v.item = l.item AND v.relation = 'own_product'),
pe AS (SELECT entity, id, count(*) FILTER (own) AS ko, count(*) FILTER (NOT own) AS kx FROM ow GROUP BY ALL), su AS (SELECT entity, count(*) FILTER (ko > 0) AS wo, count(*) FILTER (kx > 0) AS wx, count(*) FILTER (ko > 0 AND kx = 0) AS oo FROM pe GROUP BY 1),
tp AS (SELECT entity, item, row_number() OVER (PARTITION BY entity ORDER BY n DESC, item) AS pos_ FROM (SELECT entity, item, count(*) AS n FROM ow WHERE own GROUP BY ALL))
SELECT p.entity, count(*) AS postings, coalesce(any_value(wo), 0) AS postings_with_own, round(coalesce(any_value(wo), 0) / count(*)::DOUBLE, 6) AS own_share, round(avg(has_item::INT), 6) AS coverage, round(coalesce(any_value(wx), 0) / count(*)::DOUBLE, 6) AS coverage_excl_own, round(100 * coalesce(any_value(oo), 0) / count(*)::DOUBLE, 6) AS coverage_inflation_pp, coalesce(any_value(tp.item), '') AS top_own_item
FROM postings p LEFT JOIN su ON su.entity = p.entity LEFT JOIN tp ON tp.entity = p.entity AND pos_ = 1 GROUP BY 1""",
)
def self_reference(spark, d):
    p, _, long = bound(spark, d)
    return compare.self_reference(p, long, vendors(spark, d))


@query(
    "compare_item_matrix",
    f"WITH {ALL_ITEMS}, {SHARE} SELECT item, " + ", ".join(f"round(coalesce(max(CASE WHEN entity = '{e}' THEN postings_with_item / n_skilled::DOUBLE END), 0), 6) AS \"{e}\"" for e in OWN) + " FROM sh GROUP BY 1 HAVING count(DISTINCT entity) >= 2",
)
def item_matrix(spark, d):
    p, i, _ = bound(spark, d)
    return compare.item_matrix(settled(compare.item_share(p, i)), list(OWN))


TOP = "top AS (SELECT item FROM sh WHERE postings_with_item >= 10 GROUP BY 1 ORDER BY sum(postings_with_item) DESC, item LIMIT 25)"
HITS = """nn AS (SELECT entity, coalesce(segment, 'Unknown') AS segment, count(*) AS n FROM base GROUP BY ALL), kk AS (SELECT entity, coalesce(segment, 'Unknown') AS segment, item, count(DISTINCT id) AS k FROM items JOIN base USING (id) GROUP BY ALL),
cl AS (SELECT nn.entity, top.item, nn.segment, n, coalesce(k, 0)::DOUBLE AS k FROM nn CROSS JOIN top LEFT JOIN kk ON kk.entity = nn.entity AND kk.segment = nn.segment AND kk.item = top.item)"""


@query("compare_top_items", f"WITH {ALL_ITEMS}, {SHARE}, {TOP} SELECT * FROM top")
def top(spark, d):
    p, i, _ = bound(spark, d)
    return compare.top_items(settled(compare.item_share(p, i)))


@query(
    "compare_standardised_items",
    f"""WITH {ALL_ITEMS}, {SHARE}, {TOP}, {HITS}, {weights_sql('base')}, {STANDARD.format(by='entity, item')}
SELECT entity, item, round(crude, 6) AS crude_share, round(weight_covered, 6) AS weight_covered, strata_used, round(standardised, 6) AS standardised_share, round(crude - standardised, 6) AS mix_effect FROM std""",
)
def standardised_items(spark, d):
    p, i, _ = bound(spark, d)
    return compare.standardised_items(p, i, compare.top_items(settled(compare.item_share(p, i))))


_lo, _hi = wilson_sql("k", "n")
STRATUM = f"ws AS (SELECT entity, item, segment, CAST(k AS BIGINT) AS postings_with_item, n AS n_skilled, k / n AS share, {_lo} AS ci_low, {_hi} AS ci_high FROM cl WHERE n >= 10)"


@query("compare_within_stratum", f"WITH {ALL_ITEMS}, {SHARE}, {TOP}, {HITS}, {STRATUM} SELECT * REPLACE ({_ROUND(['share', 'ci_low', 'ci_high'])}) FROM ws")
def within_stratum(spark, d):
    p, i, _ = bound(spark, d)
    return compare.within_stratum(p, i, compare.top_items(settled(compare.item_share(p, i))))


@query(
    "compare_stratified_entity_verdict",
    f"""WITH {ALL_ITEMS}, {SHARE}, {TOP}, {HITS}, {STRATUM}, po AS (SELECT entity, item, sum(postings_with_item) / greatest(sum(n_skilled), 1)::DOUBLE AS pooled FROM ws GROUP BY ALL),
b AS (SELECT a.item, a.entity AS entity_a, b.entity AS entity_b, round(a.share, 4) AS pa, round(b.share, 4) AS pb, x.pooled - y.pooled AS pd FROM ws a JOIN ws b USING (item, segment) JOIN po x ON x.entity = a.entity AND x.item = a.item JOIN po y ON y.entity = b.entity AND y.item = a.item WHERE a.entity < b.entity),
c AS (SELECT item, entity_a, entity_b, pd, count(*) AS n, count(*) FILTER (sign(pa - pb) = sign(pd)) AS agree FROM b GROUP BY ALL)
SELECT item, entity_a, entity_b, CASE WHEN n >= 2 THEN round(pd, 6) END AS pooled_diff, n AS n_strata, CASE WHEN n >= 2 THEN agree ELSE 0 END AS n_agree, CASE WHEN n < 2 THEN 'unsupported' WHEN agree = n THEN 'confirmed' WHEN agree = 0 THEN 'reversed' ELSE 'mixed' END AS verdict FROM c""",
)
def stratified_entity(spark, d):
    p, i, _ = bound(spark, d)
    return compare.stratified_entity_verdict(compare.within_stratum(p, i, compare.top_items(settled(compare.item_share(p, i)))))


@query(
    "compare_panel_robustness",
    f"""WITH {ALL_ITEMS}, {COMMON}, {SHARE}, cutb AS (SELECT * FROM base SEMI JOIN common USING (publisher)), np AS (SELECT entity, count(*) AS n_panel FROM cutb GROUP BY 1), kp AS (SELECT entity, item, count(DISTINCT id) AS k FROM items JOIN cutb USING (id) GROUP BY ALL),
j AS (SELECT s.entity, s.item, item_group, postings_with_item AS k_all, n_skilled AS n_all, coalesce(k, CASE WHEN coalesce(n_panel, 0) > 0 THEN 0 END) AS k_panel, coalesce(n_panel, 0) AS n_panel FROM sh s LEFT JOIN kp ON kp.entity = s.entity AND kp.item = s.item LEFT JOIN np ON np.entity = s.entity),
q AS (SELECT *, k_all / n_all::DOUBLE AS share_all, k_panel / nullif(n_panel, 0)::DOUBLE AS share_panel FROM j)
SELECT * REPLACE (round(share_all, 6) AS share_all, round(share_panel, 6) AS share_panel), round(share_panel - share_all, 6) AS share_delta, coalesce(abs(share_panel - share_all) > 0.1, FALSE) AS channel_sensitive FROM q""",
)
def robustness(spark, d):
    p, i, _ = bound(spark, d)
    return compare.panel_robustness(p, i)


@query(
    "compare_feasibility_screen",
    f"""WITH {POSTINGS}, g AS (SELECT entity, count(*) AS postings, count(DISTINCT date_trunc('month', day)) AS months, count(DISTINCT publisher) AS publishers, min(day) AS first_day, max(day) AS last_day FROM postings GROUP BY 1)
SELECT *, CASE WHEN postings < 440 OR months < 10 THEN 'excluded' ELSE 'included' END AS verdict, concat_ws('; ', CASE WHEN postings < 440 THEN postings || ' postings (need 440)' END, CASE WHEN months < 10 THEN months || ' months (need 10)' END) AS reason FROM g""",
)
def feasibility(spark, d):
    return compare.feasibility_screen(_postings(spark, d), min_postings=440)


_LESS = RELATIVE.replace("common AS", "common2 AS").replace("hv AS", "hv2 AS").replace("dn0 AS", "dn02 AS").replace("dn1 AS", "dn12 AS").replace("dn2 AS", "dn22 AS").replace("relative AS", "relative2 AS")
for _a, _b in (("FROM postings", "FROM kept"), ("SEMI JOIN common ", "SEMI JOIN common2 "), ("JOIN hv ", "JOIN hv2 "), ("FROM dn0", "FROM dn02"), ("FROM dn1", "FROM dn12"), ("FROM dn2", "FROM dn22")):
    _LESS = _LESS.replace(_a, _b)


@query(
    "compare_half_without_month",
    f"WITH {POSTINGS}, {RELATIVE}, kept AS (SELECT * FROM postings WHERE month(day) <> 2), {_LESS} SELECT r.entity, r.log_share_change AS with_all, s.log_share_change AS without, sign(r.log_share_change) = sign(s.log_share_change) AS sign_unchanged FROM relative r JOIN relative2 s USING (entity)",
)
def half_without(spark, d):
    from pyspark.sql import functions as F

    p = _postings(spark, d)
    february = p.select(F.trunc("day", "MM").alias("start")).distinct().filter(F.month("start") == 2)
    return compare.half_without(p, february)


_SIZED = ALL_ITEMS.replace(
    "postings AS (SELECT * FROM postings_all)",
    "cnt AS (SELECT l_orderkey AS id, count(DISTINCT p_name) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), postings AS (SELECT p.* REPLACE (CASE WHEN coalesce(k, 0) < 3 THEN 'few items' WHEN k < 5 THEN 'some items' ELSE 'many items' END AS entity) FROM postings_all p LEFT JOIN cnt USING (id))",
)


def _tables_of(name: str, drop: str = "") -> str:
    """The common table expressions that a query's SQL builds on, but for the bindings."""
    return ORACLE_SQL[name].removeprefix(f"WITH {ALL_ITEMS}, ").removeprefix(drop).rsplit("\nSELECT", 1)[0]


@query(
    "compare_gaps_checked",
    f"""WITH {_SIZED}, {_tables_of('compare_pairwise_gaps')}, {_tables_of('compare_stratified_entity_verdict', SHARE + ', ')},
st AS (SELECT item, entity_a, entity_b, n AS n_strata, CASE WHEN n >= 2 THEN agree ELSE 0 END AS n_agree, CASE WHEN n < 2 THEN 'unsupported' WHEN agree = n THEN 'confirmed' WHEN agree = 0 THEN 'reversed' ELSE 'mixed' END AS verdict FROM c),
ld AS (SELECT entity_a, entity_b, item, diff, row_number() OVER (PARTITION BY entity_a, entity_b ORDER BY abs(diff) DESC, item) AS place FROM gp WHERE coalesce(q_value <= 0.05, FALSE) AND (ci_low > 0 OR ci_high < 0))
SELECT ld.entity_a, ld.entity_b, ld.item, place AS "at", round(diff, 6) AS diff, coalesce(n_strata, 0) AS n_strata, coalesce(n_agree, 0) AS n_agree, coalesce(verdict, 'unsupported') AS verdict FROM ld LEFT JOIN st USING (item, entity_a, entity_b) WHERE place <= 40""",
)
def gaps_checked(spark, d):
    """The widest significant gaps between orders of few, some and many items, checked inside priorities."""
    p, i = settled(roles.size_postings(spark, d)), settled(roles.order_items(spark, d))
    share = settled(compare.item_share(p, i))
    return compare.significant_gaps_checked(compare.pairwise_gaps(share), compare.stratified_entity_verdict(compare.within_stratum(p, i, compare.top_items(share))))


#: Publishers of the given tables that are an entity's own: include and exclude patterns of their names.
OWN_CHANNELS = [("AUTOMOBILE", r"\b(?:nation_1|nation_7)\b", ""), ("BUILDING", "nation_2", r"nation_2[0-3]"), ("MACHINERY", r"nation_[0-9]4", ""), ("FURNITURE", "nowhere", "")]
_OWN_SQL = "CASE entity " + " ".join(f"WHEN '{e}' THEN regexp_matches(publisher, '{i}', 'i')" + (f" AND NOT regexp_matches(publisher, '{x}', 'i')" if x else "") for e, i, x in OWN_CHANNELS) + " ELSE FALSE END"


@query(
    "compare_own_channels",
    f"WITH {POSTINGS}, o AS (SELECT entity, publisher, {_OWN_SQL} AS own FROM postings) SELECT entity, count(DISTINCT publisher) FILTER (own) AS own_channel_publishers, count(*) FILTER (own) AS own_channel_postings, round(count(*) FILTER (own) / count(*)::DOUBLE, 6) AS own_channel_share FROM o GROUP BY 1",
)
def own_channels(spark, d):
    p = settled(_postings(spark, d))
    rules = spark.createDataFrame([(e, i, x, []) for e, i, x in OWN_CHANNELS], "key string, include string, exclude string, brands array<struct<brand: string, pattern: string>>")
    return compare.own_channel_share(p, compare.own_channels(p, rules))
