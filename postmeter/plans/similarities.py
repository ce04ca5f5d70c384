"""Similarity of entities."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from postmeter.operators import compare, forecast, similarity
from postmeter.plans.comparison import SHARE, VENDORS, HITS, STANDARD, TOP, vendors, weights_sql
from postmeter.plans.forecasting import ALL_POSTINGS, SERIES, _postings, gate_sql
from postmeter.plans.items import ALL_ITEMS, bound
from postmeter.plans.registry import query
from postmeter.sources.tables import settled

PROFILE = f"""{SHARE}, prof AS (SELECT e.entity, v.item, coalesce(postings_with_item, 0) AS k, e.n_skilled AS n, coalesce(postings_with_item, 0) / e.n_skilled::DOUBLE AS share FROM ns e CROSS JOIN (SELECT DISTINCT item FROM sh) v LEFT JOIN sh ON sh.entity = e.entity AND sh.item = v.item),
rk AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY share) + (count(*) OVER (PARTITION BY entity, share) - 1) / 2.0::DOUBLE AS r, sum(share) OVER (PARTITION BY entity) AS tot FROM prof),
pd AS (SELECT a.entity AS entity_a, b.entity AS entity_b, item, a.share AS pa, b.share AS pb, a.k AS ka, b.k AS kb, a.r AS ra, b.r AS rb, a.share / a.tot AS na, b.share / b.tot AS nb FROM rk a JOIN rk b USING (item) WHERE a.entity < b.entity)"""
COS = "sum(pa * pb) {f} / sqrt(sum(pa * pa) {f} * sum(pb * pb) {f})"
NAMES = ("cosine", "jensen_shannon", "bray_curtis", "spearman", "jaccard_supported")
_RK = lambda c: f"rank() OVER (ORDER BY round({c}, 4) DESC NULLS LAST)"
PAIRS = f"""pt0 AS (SELECT entity_a, entity_b, {COS.format(f='')} AS cosine, 1 - sqrt(greatest((sum(CASE WHEN na > 0 THEN na * log2(na / ((na + nb) / 2)) ELSE 0 END) + sum(CASE WHEN nb > 0 THEN nb * log2(nb / ((na + nb) / 2)) ELSE 0 END)) / 2, 0)) AS jensen_shannon,
 1 - sum(abs(pa - pb)) / nullif(sum(pa + pb), 0) AS bray_curtis, corr(ra, rb) AS spearman, count(*) FILTER (ka >= 10 AND kb >= 10) / nullif(count(*) FILTER (ka >= 10 OR kb >= 10), 0)::DOUBLE AS jaccard_supported FROM pd GROUP BY ALL),
pt AS (SELECT *, {', '.join(f'{_RK(n)} AS rank_{n}' for n in NAMES)} FROM pt0)"""
_BASE = f"WITH {ALL_ITEMS}, {PROFILE}"
_R = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def profile(spark, d):
    p, i, _ = bound(spark, d)
    return settled(similarity.profiles(p, i))


@query("similarity_profiles", f"{_BASE} SELECT entity, item, k, n, round(share, 6) AS share FROM prof")
def profiles(spark, d):
    return profile(spark, d)


@query("similarity_pooled_profile", f"{_BASE} SELECT item, round(sum(k) / (SELECT sum(n_skilled) FROM ns)::DOUBLE, 6) AS share FROM prof GROUP BY 1")
def pooled(spark, d):
    return similarity.pooled_profile(profile(spark, d))


@query("similarity_supported_sets", f"{_BASE} SELECT entity, count(*) AS supported FROM prof WHERE k >= 10 GROUP BY 1")
def supported(spark, d):
    return similarity.supported_sets(profile(spark, d))


@query("similarity_pair_table", f"{_BASE}, {PAIRS} SELECT * REPLACE ({_R(NAMES)}), greatest({', '.join(f'rank_{n}' for n in NAMES)}) - least({', '.join(f'rank_{n}' for n in NAMES)}) AS rank_spread FROM pt")
def pair_table(spark, d):
    return similarity.pair_table(profile(spark, d))


@query("similarity_matrix", f"{_BASE}, {PAIRS} SELECT entity_a, entity_b, round(cosine, 6) AS similarity FROM pt UNION ALL SELECT entity_b, entity_a, round(cosine, 6) FROM pt UNION ALL SELECT entity, entity, 1.0::DOUBLE FROM ns")
def matrix(spark, d):
    return similarity.similarity_matrix(profile(spark, d))


_AVERAGE_RANKS = "ar AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY rank_{n}) + (count(*) OVER (PARTITION BY rank_{n}) - 1) / 2.0::DOUBLE AS r_{n}" for n in NAMES) + " FROM pt)"
_CORRELATIONS = " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {similarity.FAMILIES[a] == similarity.FAMILIES[b]} AS same_family, round(corr(r_{a}, r_{b}), 6) AS rank_correlation FROM ar" for a, b in itertools.combinations(NAMES, 2))


@query("similarity_metric_concordance", f"{_BASE}, {PAIRS}, {_AVERAGE_RANKS} {_CORRELATIONS}")
def concordance(spark, d):
    return similarity.concordance(similarity.pair_table(profile(spark, d)))


VENDOR = f"""vd AS (SELECT DISTINCT entity, item FROM vendors), vs0 AS (SELECT entity_a, entity_b, {COS.format(f='')} AS all_items, {COS.format(f='FILTER (NOT pair_own)')} AS pair_items_dropped, {COS.format(f='FILTER (NOT any_own)')} AS all_own_dropped
 FROM (SELECT *, EXISTS (SELECT 1 FROM vd WHERE vd.item = pd.item AND vd.entity IN (pd.entity_a, pd.entity_b)) AS pair_own, item IN (SELECT item FROM vd) AS any_own FROM pd) GROUP BY ALL),
vs AS (SELECT *, {_RK('all_items')} AS rank_all_items, {_RK('pair_items_dropped')} AS rank_pair_items_dropped, {_RK('all_own_dropped')} AS rank_all_own_dropped FROM vs0)"""


@query("similarity_vendor_sensitivity", f"{_BASE}, {VENDORS}, {VENDOR} SELECT * REPLACE ({_R(['all_items', 'pair_items_dropped', 'all_own_dropped'])}), rank_all_own_dropped - rank_all_items AS rank_move FROM vs")
def vendor(spark, d):
    return similarity.vendor_sensitivity(profile(spark, d), vendors(spark, d))


@query(
    "similarity_support_sensitivity",
    f"{_BASE}, core AS (SELECT item FROM prof GROUP BY 1 HAVING min(k) >= 10), s0 AS (SELECT entity_a, entity_b, {COS.format(f='')} AS all_items, {COS.format(f='FILTER (item IN (SELECT item FROM core))')} AS core_items, count(*) AS n_all, count(*) FILTER (item IN (SELECT item FROM core)) AS n_core FROM pd GROUP BY ALL), s1 AS (SELECT *, {_RK('all_items')} AS rank_all, {_RK('core_items')} AS rank_core FROM s0) SELECT * REPLACE ({_R(['all_items', 'core_items'])}), rank_core - rank_all AS rank_move FROM s1",
)
def support(spark, d):
    return similarity.support_sensitivity(profile(spark, d))


@query(
    "similarity_group_removal",
    f"{_BASE}, g0 AS (SELECT entity_a, entity_b, {COS.format(f='')} AS with_group, {COS.format(f='''FILTER (item NOT LIKE '% gear')''')} AS without_group FROM pd GROUP BY ALL) SELECT entity_a, entity_b, round(with_group, 6) AS with_group, round(without_group, 6) AS without_group, round(without_group - with_group, 6) AS delta, {_RK('with_group')} AS rank_with, {_RK('without_group')} AS rank_without FROM g0",
)
def removal(spark, d):
    return similarity.group_removal(profile(spark, d), F.col("item").endswith(" gear"))


@query(
    "similarity_numerator_contribution",
    f"""{_BASE}, q AS (SELECT *, pa * pb AS prod, row_number() OVER (PARTITION BY entity_a, entity_b ORDER BY pa * pb DESC, item) AS pos_ FROM pd)
SELECT entity_a, entity_b, round(sum(prod), 6) AS numerator, round(coalesce(sum(prod) FILTER (item LIKE '% ring'), 0) / sum(prod), 6) AS share_rings, count(*) FILTER (item LIKE '% ring') AS n_rings, round(sum(prod) FILTER (pos_ <= 5) / sum(prod), 6) AS share_top5, string_agg(item, ', ' ORDER BY pos_) FILTER (pos_ <= 5) AS top5_items FROM q GROUP BY ALL""",
)
def contribution(spark, d):
    return similarity.numerator_contribution(profile(spark, d), {"rings": F.col("item").endswith(" ring")})


_C = "sum({0}a * {0}b) / nullif(sqrt(sum({0}a * {0}a) * sum({0}b * {0}b)), 0)"


@query(
    "similarity_mix_sensitivity",
    f"""WITH {ALL_ITEMS}, {SHARE}, {TOP}, {HITS}, {weights_sql('base')}, {STANDARD.format(by='entity, item')}, z AS (SELECT entity, item, coalesce(crude, 0) AS c, coalesce(standardised, 0) AS s, weight_covered AS w FROM std),
j AS (SELECT a.entity AS entity_a, b.entity AS entity_b, a.c AS ca, b.c AS cb, a.s AS sa, b.s AS sb, least(a.w, b.w) AS w FROM z a JOIN z b USING (item) WHERE a.entity < b.entity), k AS (SELECT entity_a, entity_b, {_C.format('c')} AS crude, {_C.format('s')} AS standardised, count(*) AS items_used, min(w) AS weight_covered_min FROM j GROUP BY ALL),
l AS (SELECT *, crude - standardised AS mix_effect, {_RK('crude')} AS rank_crude, {_RK('standardised')} AS rank_standardised FROM k) SELECT * REPLACE ({_R(['crude', 'standardised', 'weight_covered_min', 'mix_effect'])}), rank_standardised - rank_crude AS rank_move FROM l""",
)
def mix(spark, d):
    p, i, _ = bound(spark, d)
    return similarity.mix_sensitivity(compare.standardised_items(p, i, compare.top_items(settled(compare.item_share(p, i)))))


@query("similarity_calibration")
def calibration(spark, d):
    return similarity.calibration(profile(spark, d))


@query("similarity_bootstrap")
def bootstrap(spark, d):
    return similarity.rank_tiers(similarity.bootstrap(*bound(spark, d)[:2]))


@query("similarity_cluster_support")
def cluster_support(spark, d):
    return similarity.cluster_support(*bound(spark, d)[:2])


@query("similarity_cluster_support_without_products")
def cluster_support_without_products(spark, d):
    """Support of the partitions when every entity's own products are left out: stable under redrawing is not stable under another vocabulary."""
    p, i = bound(spark, d)[:2]
    return similarity.cluster_support(p, i.join(vendors(spark, d).select("item").distinct(), "item", "left_anti"))


_GRID = ", ".join(f"{0.40 + 0.05 * k:.2f}::DOUBLE" for k in range(13))


@query(
    "similarity_network_thresholds",
    f"""{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {PAIRS}, gr AS (SELECT unnest([{_GRID}]) AS threshold), ed AS (SELECT threshold, entity_a AS x, entity_b AS y FROM pt, gr WHERE round(cosine, 4) >= threshold), bo AS (SELECT * FROM ed UNION ALL SELECT threshold, y, x FROM ed),
re AS (SELECT threshold, entity AS x, entity AS y FROM ns, gr UNION SELECT re.threshold, re.x, bo.y FROM re JOIN bo ON bo.threshold = re.threshold AND bo.x = re.y), la AS (SELECT threshold, x, min(y) AS l FROM re GROUP BY ALL),
de AS (SELECT threshold, x, count(*) AS d FROM bo GROUP BY ALL) SELECT la.threshold, CAST(coalesce(sum(d) / 2, 0) AS BIGINT) AS edges, count(DISTINCT l) AS components, coalesce(string_agg(la.x, ',' ORDER BY la.x) FILTER (d IS NULL), '') AS isolated, count(*) FILTER (d IS NULL) AS n_isolated FROM la LEFT JOIN de USING (threshold, x) GROUP BY 1""",
)
def network(spark, d):
    p = profile(spark, d)
    return similarity.network_thresholds(similarity.pair_table(p), p.select("entity").distinct())


@query(
    "similarity_trajectories",
    f"""WITH {ALL_POSTINGS}, {SERIES}, {gate_sql(3)}, cm AS (SELECT start FROM series WHERE is_observed AND share > 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT key) FROM series)), s AS (SELECT key, start, ln(share) AS l, ln(share) - avg(ln(share)) OVER (PARTITION BY start) AS c FROM series SEMI JOIN cm USING (start)),
p AS (SELECT a.key AS entity_a, b.key AS entity_b, count(*) AS n_periods, corr(a.l, b.l) AS r, corr(a.c, b.c) AS rc, var_samp(a.l - b.l) AS av FROM s a JOIN s b USING (start) WHERE a.key < b.key GROUP BY ALL),
q AS (SELECT p.*, ga.verdict = 'forecastable' AS gate_a, gb.verdict = 'forecastable' AS gate_b, tanh(atanh(r) - 1.96::DOUBLE / sqrt(n_periods - 3)) AS lo, tanh(atanh(r) + 1.96::DOUBLE / sqrt(n_periods - 3)) AS hi FROM p JOIN gate ga ON ga.key = entity_a JOIN gate gb ON gb.key = entity_b)
SELECT entity_a, entity_b, gate_a, gate_b, n_periods, round(r, 6) AS r_log_share, round(rc, 6) AS r_clr, round(av, 6) AS aitchison_variation, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(hi - lo, 6) AS ci_width, gate_a AND gate_b AND n_periods >= 8 AS eligible, lo > 0 OR hi < 0 AS excludes_zero FROM q""",
)
def trajectories(spark, d):
    s = settled(forecast.panel_share_series(_postings(spark, d)))
    return similarity.trajectories(s, forecast.forecastability(s, min_cell=3))


_WIDE = "cm AS (SELECT start FROM series WHERE is_observed AND share > 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT key) FROM series)), wide AS (SELECT key, start, ln(share) - avg(ln(share)) OVER (PARTITION BY start) AS c FROM series SEMI JOIN cm USING (start))"


@query("similarity_calibrated_sigma", f"WITH {ALL_POSTINGS}, {SERIES}, {_WIDE}, t AS (SELECT count(DISTINCT start) AS n_periods, count(DISTINCT key) AS n_parts, stddev_samp(c) AS s FROM wide) SELECT n_periods, n_parts, round(s * sqrt(n_parts / (n_parts - 1)::DOUBLE), 6) AS sigma FROM t")
def sigma(spark, d):
    return similarity.calibrated_sigma(forecast.panel_share_series(_postings(spark, d)))


def _closure(spark, d, more=()):
    """Trajectories, the null at the series' own periods, parts and dispersion (and at multiples of it), and that dispersion."""
    s = settled(forecast.panel_share_series(_postings(spark, d)))
    table = similarity.trajectories(s, forecast.forecastability(s, min_cell=3))
    own = similarity.calibrated_sigma(s).first()
    periods, parts, own_sigma = max(own.n_periods, 2), max(own.n_parts, 2), own.sigma or similarity.DEFAULT_SIGMA
    return table, similarity.closure_null(spark, periods, parts, [own_sigma * m for m in (1.0, *more)])


@query("similarity_trajectory_verdict")
def trajectory_verdict(spark, d):
    return similarity.trajectory_verdict(*_closure(spark, d))


@query("similarity_closure_sensitivity")
def closure_sensitivity(spark, d):
    table, null = _closure(spark, d, (0.25, 0.5, 2.0, 4.0))
    return similarity.closure_sensitivity(table.agg(F.avg("r_log_share")).first()[0] or 0.0, null)


@query("similarity_mean_off_diagonal", f"{_BASE}, {PAIRS} SELECT round(avg(cosine), 6) AS mean_cosine, count(*) AS pairs FROM pt")
def mean_off_diagonal(spark, d):
    return similarity.similarity_matrix(profile(spark, d)).filter("entity_a < entity_b").agg(F.avg("similarity").alias("mean_cosine"), F.count("*").alias("pairs"))


@query("similarity_pair_verdicts")
def pair_verdicts(spark, d):
    p, i, _ = bound(spark, d)
    prof = settled(similarity.profiles(p, i))
    mixed = similarity.mix_sensitivity(compare.standardised_items(p, i, compare.supported_items(settled(compare.item_share(p, i)))))
    return similarity.pair_verdicts(similarity.bootstrap(p, i), similarity.pair_table(prof), similarity.vendor_sensitivity(prof, vendors(spark, d)), mixed)
