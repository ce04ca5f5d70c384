"""Series, gate, backtests and horizons."""

from __future__ import annotations

from postmeter import roles
from postmeter.operators import forecast, replicates
from postmeter.plans.comparison import erfc_sql
from postmeter.plans.items import ALL_ITEMS, bound
from postmeter.plans.registry import COMMON, ELIGIBLE, POSTINGS, PRICES, query
from postmeter.sources.tables import settled

ALL_POSTINGS = POSTINGS
SIMPLE = ("naive", "mean", "drift")


def _postings(spark, d):
    return roles.order_postings(spark, d)


SERIES = f"""{COMMON}, st AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS start FROM postings), cn AS (SELECT entity, start, count(*) AS n FROM st SEMI JOIN common USING (publisher) GROUP BY ALL),
obs AS (SELECT DISTINCT start FROM (SELECT start, publisher FROM st WHERE publisher IS NOT NULL GROUP BY ALL HAVING count(DISTINCT entity) = (SELECT count(DISTINCT entity) FROM postings))),
gr AS (SELECT e.entity AS key, s.start, coalesce(n, 0) AS numerator FROM (SELECT DISTINCT entity FROM postings) e CROSS JOIN (SELECT DISTINCT start FROM cn) s LEFT JOIN cn ON cn.entity = e.entity AND cn.start = s.start),
gd AS (SELECT *, CAST(sum(numerator) OVER (PARTITION BY start) AS BIGINT) AS denominator FROM gr),
series AS (SELECT *, numerator / nullif(denominator, 0)::DOUBLE AS share, start IN (SELECT start FROM obs) AND denominator > 0 AS is_observed FROM gd)"""


@query("forecast_unobserved_periods", f"WITH {POSTINGS}, {SERIES} SELECT DISTINCT start FROM st WHERE start NOT IN (SELECT start FROM obs)")
def unobserved(spark, d):
    return forecast.unobserved_periods(roles.order_postings(spark, d))


@query("forecast_panel_share_series", f"WITH {ALL_POSTINGS}, {SERIES} SELECT key, start, numerator, denominator, round(share, 6) AS share, is_observed FROM series")
def share_series(spark, d):
    return settled(forecast.panel_share_series(_postings(spark, d)))


@query("forecast_pool_series", f"WITH {ALL_POSTINGS}, {SERIES} SELECT 'panel_pool' AS key, start, CAST(sum(numerator) AS BIGINT) AS numerator, CAST(sum(numerator) AS BIGINT) AS denominator, sum(numerator)::DOUBLE AS share, any_value(is_observed) AS is_observed FROM series GROUP BY start")
def pool(spark, d):
    return forecast.pool_series(_postings(spark, d))


@query("forecast_count_series", f"WITH {ALL_POSTINGS}, {SERIES} SELECT key, start, numerator, numerator AS denominator, numerator::DOUBLE AS share, is_observed FROM series")
def counts(spark, d):
    return forecast.count_series(_postings(spark, d))


@query(
    "forecast_item_share_series",
    f"""WITH {ALL_ITEMS}, {ELIGIBLE}, bb AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS start FROM base WHERE entity = 'BUILDING'), nn AS (SELECT start, count(*) AS denominator FROM bb GROUP BY 1),
hh AS (SELECT item, id, start FROM items JOIN bb USING (id)), be AS (SELECT item FROM hh GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 15)
SELECT be.item AS key, nn.start, coalesce(k, 0) AS numerator, denominator, round(coalesce(k, 0) / denominator::DOUBLE, 6) AS share, TRUE AS is_observed FROM be CROSS JOIN nn LEFT JOIN (SELECT item, start, count(DISTINCT id) AS k FROM hh GROUP BY ALL) x ON x.item = be.item AND x.start = nn.start""",
)
def item_series(spark, d):
    p, i, _ = bound(spark, d)
    return forecast.item_share_series(p, i, "BUILDING")


def gate_sql(min_cell: int = 5, name: str = "gate") -> str:
    z = "((pow(od, 1.0::DOUBLE / 3) - (1 - 2.0::DOUBLE / (9 * dfr))) / sqrt(2.0::DOUBLE / (9 * dfr)))"
    tail = f"CASE WHEN {z} >= 0 THEN {erfc_sql(f'{z} / sqrt(2.0::DOUBLE)')} / 2 ELSE 1 - {erfc_sql(f'-{z} / sqrt(2.0::DOUBLE)')} / 2 END"
    return f"""{name}0 AS (SELECT *, sum(numerator) OVER (PARTITION BY key) / sum(denominator) OVER (PARTITION BY key)::DOUBLE AS p FROM series WHERE is_observed),
{name}1 AS (SELECT key, count(*) AS n, min(numerator) AS mc, median(denominator::DOUBLE) AS md, avg(share) AS ms, stddev_samp(share) AS sd, any_value(p) AS p, sum(CASE WHEN p > 0 AND p < 1 THEN pow(numerator - denominator * p, 2) / (denominator * p * (1 - p)) END) AS c2 FROM {name}0 GROUP BY 1),
{name}2 AS (SELECT k.key, coalesce(n, 0) AS n, coalesce(mc, 0) AS mc, md, ms, sd, p, CASE WHEN n >= 2 THEN CASE WHEN p <= 0 OR p >= 1 THEN 0.0::DOUBLE ELSE c2 END END AS chi2, coalesce(n, 0) - 1 AS dfr FROM (SELECT DISTINCT key FROM series) k LEFT JOIN {name}1 g ON g.key = k.key),
{name}3 AS (SELECT *, chi2 / dfr AS od FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN p <= 0 OR p >= 1 THEN 1.0::DOUBLE ELSE {tail} END END AS hp FROM {name}3),
{name} AS (SELECT key, n AS n_observed, mc AS min_cell, md AS median_denominator, ms AS mean_share, sd / nullif(ms, 0) AS cv, chi2, CASE WHEN n >= 2 THEN dfr ELSE 0 END AS df, hp AS homogeneity_p, od AS overdispersion, CASE WHEN od > 0 THEN greatest(0.0::DOUBLE, 1 - 1 / od) WHEN n >= 2 THEN 0.0::DOUBLE END AS signal_share,
 CASE WHEN n < 8 OR mc < {min_cell} THEN 'too_thin' WHEN coalesce(hp < 0.05, FALSE) THEN 'forecastable' ELSE 'noise_only' END AS verdict FROM {name}4)"""


_R6 = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("forecast_forecastability", f"WITH {ALL_POSTINGS}, {SERIES}, {gate_sql()} SELECT * REPLACE ({_R6(['median_denominator', 'mean_share', 'cv', 'chi2', 'homogeneity_p', 'overdispersion', 'signal_share'])}) FROM gate")
def gate(spark, d):
    return forecast.forecastability(settled(forecast.panel_share_series(_postings(spark, d))))


@query(
    "forecast_gate_sensitivity",
    f"WITH {ALL_POSTINGS}, {SERIES}, {gate_sql(3, 'ga')}, {gate_sql(5, 'gb')}, {gate_sql(10, 'gc')} SELECT cutoff, count(*) FILTER (verdict = 'forecastable') AS forecastable, coalesce(string_agg(key, ', ' ORDER BY key) FILTER (verdict = 'forecastable'), '') AS keys FROM (SELECT CAST(3 AS BIGINT) AS cutoff, key, verdict FROM ga UNION ALL SELECT 5, key, verdict FROM gb UNION ALL SELECT 10, key, verdict FROM gc) GROUP BY 1",
)
def gate_sensitivity(spark, d):
    return forecast.gate_sensitivity(settled(forecast.panel_share_series(_postings(spark, d))))


BACKTEST = """ty AS (SELECT key, start, share, ln(greatest(share, 0.5::DOUBLE / greatest(denominator, 1))) AS y, row_number() OVER (PARTITION BY key ORDER BY start) AS i, (year(start) * 12 + month(start)) - min(year(start) * 12 + month(start)) OVER (PARTITION BY key) AS t FROM series WHERE is_observed),
tr AS (SELECT *, avg(y) OVER w AS mean_y, first_value(y) OVER w AS y0, first_value(t) OVER w AS t0 FROM ty WINDOW w AS (PARTITION BY key ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bt0 AS (SELECT o.key, h AS horizon, o.start AS origin, g.start AS target, o.i AS n_train, g.y AS actual, o.y AS p_naive, o.mean_y AS p_mean, o.y + CASE WHEN o.t > o.t0 THEN (o.y - o.y0) / (o.t - o.t0)::DOUBLE ELSE 0 END * (g.t - o.t) AS p_drift FROM tr o CROSS JOIN (VALUES (1), (2), (3)) v(h) JOIN ty g ON g.key = o.key AND g.i = o.i + h WHERE o.i >= 5),
bt AS (SELECT key, 'naive' AS model, horizon, origin, target, n_train, actual, p_naive AS predicted, actual - p_naive AS error FROM bt0 UNION ALL SELECT key, 'mean', horizon, origin, target, n_train, actual, p_mean, actual - p_mean FROM bt0 UNION ALL SELECT key, 'drift', horizon, origin, target, n_train, actual, p_drift, actual - p_drift FROM bt0)"""
_BT = f"WITH {ALL_POSTINGS}, {SERIES}, {BACKTEST}"


def simple_backtest(spark, d):
    return forecast.backtest(settled(forecast.panel_share_series(_postings(spark, d))), SIMPLE)


@query("forecast_backtest", f"{_BT} SELECT key, model, CAST(horizon AS BIGINT) AS horizon, origin, target, n_train, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(error, 6) AS error FROM bt")
def backtest(spark, d):
    return simple_backtest(spark, d)


@query("forecast_backtest_all_models")
def backtest_all(spark, d):
    return forecast.backtest(settled(forecast.panel_share_series(_postings(spark, d))))


ACCURACY = "ac AS (SELECT horizon, model, count(*) AS n, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae, avg(error) AS bias FROM bt GROUP BY ALL)"


@query(
    "forecast_accuracy",
    f"{_BT}, {ACCURACY} SELECT CAST(a.horizon AS BIGINT) AS horizon, a.model, a.n, round(a.rmse, 6) AS rmse, round(a.mae, 6) AS mae, round(a.bias, 6) AS bias, round(a.rmse / b.rmse, 6) AS rmse_ratio_to_naive, round(a.mae / b.mae, 6) AS mase, round(exp(a.rmse), 6) AS error_factor FROM ac a JOIN ac b ON b.horizon = a.horizon AND b.model = 'naive'",
)
def accuracy(spark, d):
    return forecast.accuracy(simple_backtest(spark, d))


def contest_sql(by: str = "") -> str:
    stat = "CASE WHEN se = 0 THEN 0.0::DOUBLE ELSE m / nullif(se, 0) END"
    return f"""df AS (SELECT a.key, a.model, a.horizon, a.error, b.error AS b, a.error * a.error - b.error * b.error AS d FROM bt a JOIN bt b ON b.key = a.key AND b.horizon = a.horizon AND b.target = a.target AND b.model = 'naive' WHERE a.model <> 'naive'),
cs AS (SELECT model, horizon {by}, count(*) AS n_pairs, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se, sqrt(avg(error * error)) AS rmse, sqrt(avg(b * b)) AS benchmark_rmse FROM df GROUP BY ALL),
ct AS (SELECT *, CASE WHEN n_pairs >= 3 THEN {stat} END AS dm_stat FROM cs), contest AS (SELECT *, CASE WHEN n_pairs >= 3 THEN CASE WHEN se = 0 THEN 1.0::DOUBLE ELSE {erfc_sql('abs(dm_stat) / sqrt(2.0::DOUBLE)')} END END AS p_value FROM ct)"""


@query(
    "forecast_model_contest",
    f"{_BT}, {contest_sql()} SELECT model, CAST(horizon AS BIGINT) AS horizon, n_pairs, round(rmse, 6) AS rmse, round(benchmark_rmse, 6) AS benchmark_rmse, round(dm_stat, 6) AS dm_stat, round(p_value, 6) AS p_value, coalesce(p_value < 0.05 AND dm_stat < 0, FALSE) AS beats_benchmark FROM contest",
)
def contest(spark, d):
    return forecast.contest(simple_backtest(spark, d))


@query(
    "forecast_select_model",
    f"""{_BT}, {contest_sql(', key')}, rm AS (SELECT key, model, sqrt(avg(error * error)) AS rmse, CASE model WHEN 'naive' THEN 1 WHEN 'mean' THEN 2 ELSE 3 END AS o FROM bt WHERE horizon = 1 GROUP BY ALL),
lo AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rmse, o) AS r FROM rm), wn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rmse, CASE model WHEN 'mean' THEN 2 ELSE 3 END) AS r FROM contest WHERE horizon = 1 AND p_value < 0.05 AND dm_stat < 0 AND rmse < benchmark_rmse)
SELECT b.key, CAST(1 AS BIGINT) AS horizon, coalesce(w.model, 'naive') AS selected, CASE WHEN w.model IS NULL THEN 'benchmark_not_beaten' ELSE 'beats_benchmark' END AS selected_by, round(coalesce(w.rmse, b.rmse), 6) AS selected_rmse, round(w.p_value, 6) AS dm_p_value, round(w.dm_stat, 6) AS dm_stat, l.model AS lowest_rmse_model, round(l.rmse, 6) AS lowest_rmse, l.model <> coalesce(w.model, 'naive') AS would_have_picked_differently
FROM rm b JOIN lo l ON l.key = b.key AND l.r = 1 LEFT JOIN wn w ON w.key = b.key AND w.r = 1 WHERE b.model = 'naive'""",
)
def select_model(spark, d):
    return forecast.select_model(simple_backtest(spark, d))


def intervals_sql(by: str = "") -> str:
    return f"""iv0 AS (SELECT model, horizon {by}, list_sort(list(error)) AS r, count(*) AS n, CAST(floor((1 - 0.8::DOUBLE) / 2 * (count(*) + 1)) AS INT) AS j FROM bt GROUP BY ALL),
iv1 AS (SELECT *, n >= 3 AND j >= 1 AS sufficient FROM iv0), iv AS (SELECT *, CASE WHEN sufficient THEN r[j] END AS lo, CASE WHEN sufficient THEN r[n - j + 1] END AS hi FROM iv1)"""


INTERVALS = intervals_sql()


@query(
    "forecast_intervals",
    f"{_BT}, {INTERVALS} SELECT model, CAST(horizon AS BIGINT) AS horizon, n AS n_residuals, sufficient, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN sufficient THEN round((n + 1 - 2 * j) / (n + 1)::DOUBLE, 6) END AS achieved_level, CASE WHEN sufficient THEN round(len(list_filter(r, lambda e: e >= lo AND e <= hi)) / n::DOUBLE, 6) END AS covered FROM iv",
)
def intervals(spark, d):
    return forecast.intervals(simple_backtest(spark, d))


@query(
    "forecast_horizons",
    f"{_BT}, {ACCURACY}, {INTERVALS} SELECT CAST(a.horizon AS BIGINT) AS horizon, a.n AS n_origins, round(rmse, 6) AS rmse, round(mae, 6) AS mae, iv.n AS n_residuals, sufficient, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN sufficient THEN round((iv.n + 1 - 2 * j) / (iv.n + 1)::DOUBLE, 6) END AS achieved_level, CASE WHEN sufficient THEN round(len(list_filter(r, lambda e: e >= lo AND e <= hi)) / iv.n::DOUBLE, 6) END AS covered, round(exp(hi - lo), 6) AS interval_factor FROM ac a JOIN iv ON iv.model = a.model AND iv.horizon = a.horizon WHERE a.model = 'naive'",
)
def horizons(spark, d):
    return forecast.horizons(simple_backtest(spark, d))


@query(
    "forecast_horizon_verdict",
    f"{_BT}, {INTERVALS}, hz AS (SELECT horizon, sufficient, sufficient AND coalesce(exp(hi - lo) <= 3, FALSE) AS usable FROM iv WHERE model = 'naive'), rn AS (SELECT *, bool_and(usable) OVER (ORDER BY horizon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM hz) SELECT CAST(coalesce(max(horizon) FILTER (ok), 0) AS BIGINT) AS max_useful_horizon, coalesce((SELECT 'h=' || horizon || ': ' || CASE WHEN NOT sufficient THEN 'no interval' ELSE 'interval excludes nothing' END FROM rn WHERE NOT ok ORDER BY horizon LIMIT 1), '') AS blocker FROM rn",
)
def horizon_verdict(spark, d):
    return forecast.horizon_verdict(forecast.horizons(simple_backtest(spark, d)))




def _price_series(spark, d):
    return settled(forecast.panel_share_series(roles.price_postings(spark, d)))


@query("forecast_table")
def table(spark, d):
    """Forecasts of all seven models over classes of real prices, whose shares move."""
    s = _price_series(spark, d)
    tested = settled(forecast.backtest(s))
    return forecast.forecast(s, forecast.select_model(tested), tested, settled(forecast.forecastability(s)))


PRICED = f"WITH {PRICES}, {SERIES}, {gate_sql()}, {BACKTEST}"
_GATED = "gbt AS (SELECT * FROM bt WHERE key IN (SELECT key FROM gate WHERE verdict = 'forecastable'))"
_SELECTED = """rm AS (SELECT key, model, sqrt(avg(error * error)) AS rmse FROM bt WHERE horizon = 1 GROUP BY ALL),
wn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rmse, CASE model WHEN 'mean' THEN 2 ELSE 3 END) AS r FROM contest WHERE horizon = 1 AND p_value < 0.05 AND dm_stat < 0 AND rmse < benchmark_rmse),
sel AS (SELECT b.key, coalesce(w.model, 'naive') AS selected, CASE WHEN w.model IS NULL THEN 'benchmark_not_beaten' ELSE 'beats_benchmark' END AS selected_by FROM rm b LEFT JOIN wn w ON w.key = b.key AND w.r = 1 WHERE b.model = 'naive')"""
_USEFUL = "hz AS (SELECT horizon, sufficient AND coalesce(exp(hi - lo) <= 3, FALSE) AS usable FROM iv WHERE model = 'naive'), rn AS (SELECT *, bool_and(usable) OVER (ORDER BY horizon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM hz), useful AS (SELECT coalesce(max(horizon) FILTER (ok), 0) AS h FROM rn)"


@query("forecast_priced_gate", f"{PRICED} SELECT * REPLACE ({_R6(['median_denominator', 'mean_share', 'cv', 'chi2', 'homogeneity_p', 'overdispersion', 'signal_share'])}) FROM gate")
def priced_gate(spark, d):
    """The gate over classes of real prices, which pass it."""
    return forecast.forecastability(_price_series(spark, d))


@query(
    "forecast_table_simple",
    f"""{PRICED}, {contest_sql(', key')}, {_SELECTED}, {_GATED}, {INTERVALS.replace('FROM bt', 'FROM gbt')}, {_USEFUL},
las AS (SELECT * FROM tr WHERE key IN (SELECT key FROM gate WHERE verdict = 'forecastable') QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
pt AS (SELECT l.key, CAST(l.start + to_months(CAST(h AS INTEGER)) AS DATE) AS target, h AS horizon, s.selected AS model, s.selected_by, l.share, l.i AS n_train,
  CASE s.selected WHEN 'naive' THEN l.y WHEN 'mean' THEN l.mean_y ELSE l.y + CASE WHEN l.t > l.t0 THEN (l.y - l.y0) / (l.t - l.t0)::DOUBLE ELSE 0 END * h END AS lp FROM las l JOIN sel s USING (key) CROSS JOIN (VALUES (1), (2), (3)) v(h) WHERE l.i > 5)
SELECT p.key, p.target, CAST(p.horizon AS BIGINT) AS horizon, p.model, p.selected_by, round(p.share, 6) AS last_observed_share, round(exp(lp), 6) AS point_share, round(exp(lp + lo), 6) AS lo_share, round(exp(lp + hi), 6) AS hi_share, n AS n_residuals, n_train,
 coalesce(sufficient, FALSE) AND p.horizon <= (SELECT h FROM useful) AS supported, TRUE AS out_of_window FROM pt p LEFT JOIN iv ON iv.model = p.model AND iv.horizon = p.horizon""",
)
def table_simple(spark, d):
    """Forecasts of the three models that SQL can state, over classes of real prices."""
    s = _price_series(spark, d)
    tested = settled(forecast.backtest(s, SIMPLE))
    return forecast.forecast(s, forecast.select_model(tested), tested, settled(forecast.forecastability(s)))


@query(
    "forecast_interval_coverage",
    f"""{PRICED}, {_GATED}, pooled AS (SELECT *, 'all' AS pool FROM bt UNION ALL SELECT *, 'gated' FROM gbt), {intervals_sql(', pool').replace('FROM bt', 'FROM pooled')}
SELECT pool, model, CAST(horizon AS BIGINT) AS horizon, CASE WHEN sufficient THEN round(len(list_filter(r, lambda e: e >= lo AND e <= hi)) / n::DOUBLE, 6) END AS covered, 0.8::DOUBLE AS nominal, CASE WHEN sufficient THEN round((n + 1 - 2 * j) / (n + 1)::DOUBLE, 6) END AS achieved, n FROM iv""",
)
def interval_coverage(spark, d):
    s = _price_series(spark, d)
    return forecast.interval_coverage(settled(forecast.backtest(s, SIMPLE)), settled(forecast.forecastability(s)))


# Replicates carry a publisher's name before their key.
_LESS = """base AS (SELECT * FROM series0), cells AS (SELECT publisher AS dropped, entity AS key, start, count(*) AS n FROM st SEMI JOIN common USING (publisher) GROUP BY ALL),
lost AS (SELECT dropped, start, sum(n) AS gone FROM cells GROUP BY ALL),
series1 AS (SELECT '(none)' AS dropped, key AS k, start, numerator, denominator, share, is_observed FROM base UNION ALL
 SELECT d.dropped, b.key, b.start, b.numerator - coalesce(c.n, 0), CAST(b.denominator - coalesce(l.gone, 0) AS BIGINT), NULL, b.is_observed FROM (SELECT DISTINCT dropped FROM cells) d CROSS JOIN base b LEFT JOIN cells c ON c.dropped = d.dropped AND c.key = b.key AND c.start = b.start LEFT JOIN lost l ON l.dropped = d.dropped AND l.start = b.start),
series AS (SELECT dropped, k, dropped || chr(31) || k AS key, start, numerator, denominator, numerator / nullif(denominator, 0)::DOUBLE AS share, is_observed AND denominator > 0 AS is_observed FROM series1)"""
WITHOUT_EACH = f"WITH {PRICES}, {SERIES.replace('series AS (SELECT *, numerator', 'series0 AS (SELECT *, numerator')}, {_LESS}, {gate_sql()}"
_DROPPED = "split_part(key, chr(31), 1)"


@query("forecast_series_without_each", f"{WITHOUT_EACH} SELECT dropped, k AS key, start, numerator, denominator, round(share, 6) AS share, is_observed FROM series")
def series_without_each(spark, d):
    p = roles.price_postings(spark, d)
    return replicates.series_without_each(settled(forecast.panel_share_series(p)), settled(replicates.panel_cells(p)))


@query("forecast_gate_without_each", f"{WITHOUT_EACH} SELECT {_DROPPED} AS dropped, split_part(key, chr(31), 2) AS key, n_observed, min_cell, round(signal_share, 6) AS signal_share, round(homogeneity_p, 6) AS homogeneity_p, verdict FROM gate")
def gate_without_each(spark, d):
    return replicates.gate_without_each(settled(series_without_each(spark, d))).select("dropped", "key", "n_observed", "min_cell", "signal_share", "homogeneity_p", "verdict")


def verdicts_sql(focus: str) -> str:
    return f"""{WITHOUT_EACH}, {BACKTEST}, {contest_sql(f', {_DROPPED} AS dropped')}, {_GATED}, {intervals_sql(f', {_DROPPED} AS dropped').replace('FROM bt', 'FROM gbt')},
du AS (SELECT dropped, bool_or(coalesce(p_value < 0.05 AND dm_stat < 0, FALSE)) AS any_model_beats_naive, min(p_value) AS smallest_p_value FROM contest WHERE horizon = 1 GROUP BY 1),
ke AS (SELECT {_DROPPED} AS dropped, coalesce(string_agg(split_part(key, chr(31), 2), ', ' ORDER BY key) FILTER (verdict = 'forecastable'), '') AS forecastable FROM gate GROUP BY 1),
hz AS (SELECT dropped, horizon, exp(hi - lo) AS f, sufficient AND coalesce(exp(hi - lo) <= 3, FALSE) AS usable FROM iv WHERE model = 'naive'),
rn AS (SELECT *, bool_and(usable) OVER (PARTITION BY dropped ORDER BY horizon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM hz),
us AS (SELECT dropped, coalesce(max(horizon) FILTER (ok), 0) AS h, max(f) FILTER (horizon = 1) AS f FROM rn GROUP BY 1),
fo AS (SELECT dropped, max(share) AS m, 100 * greatest(max(share) - avg(share), avg(share) - min(share)) AS v FROM series WHERE k = '{focus}' AND is_observed GROUP BY 1),
al AS (SELECT dropped, forecastable, coalesce(any_model_beats_naive, FALSE) AS b, smallest_p_value, f, coalesce(h, 0) AS h, m, v, (SELECT count(DISTINCT dropped) - 1 FROM series) - CASE WHEN dropped = '(none)' THEN 0 ELSE 1 END AS np FROM ke LEFT JOIN du USING (dropped) LEFT JOIN us USING (dropped) LEFT JOIN fo USING (dropped))
SELECT a.dropped, a.forecastable, a.b AS any_model_beats_naive, round(a.smallest_p_value, 6) AS smallest_p_value, round(a.f, 6) AS h1_interval_factor, CAST(a.h AS BIGINT) AS max_useful_horizon, round(a.m, 6) AS focus_max_share, round(a.v, 6) AS focus_largest_move_pp, a.np AS n_publishers,
 a.forecastable = z.forecastable AND a.b = z.b AND a.h = z.h AS verdict_unchanged FROM al a, (SELECT * FROM al WHERE dropped = '(none)') z"""


@query("forecast_verdicts_without_each", verdicts_sql("large"))
def verdicts_without_each(spark, d):
    return replicates.verdicts_without_each(settled(series_without_each(spark, d)), "large", SIMPLE)


@query("forecast_verdicts_without_each_all_models")
def verdicts_without_each_all(spark, d):
    """The same with all seven models; tests hold every replicate against a run without its publisher."""
    return replicates.verdicts_without_each(settled(series_without_each(spark, d)), "large")


@query(
    "forecast_levels_against_shares",
    f"""WITH {ALL_POSTINGS}, {SERIES}, u AS (SELECT 'share' AS s, key, start, ln(greatest(share, 0.5::DOUBLE / greatest(denominator, 1))) AS y FROM series WHERE is_observed UNION ALL SELECT 'count', key, start, ln(greatest(numerator::DOUBLE, 0.5::DOUBLE / greatest(numerator, 1))) FROM series WHERE is_observed
 UNION ALL SELECT 'pool', 'panel_pool', start, ln(greatest(sum(numerator)::DOUBLE, 0.5::DOUBLE / greatest(sum(numerator), 1))) FROM series WHERE is_observed GROUP BY start), e AS (SELECT s, y - lag(y) OVER w AS e, row_number() OVER w AS i FROM u WINDOW w AS (PARTITION BY s, key ORDER BY start))
SELECT s AS series, count(e) AS n, round(sqrt(avg(e * e)), 6) AS naive_rmse FROM e WHERE i > 5 GROUP BY 1""",
)
def levels(spark, d):
    return forecast.levels_against_shares(_postings(spark, d))
