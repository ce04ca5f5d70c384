"""Volume, panels, spikes and seasonality."""

from __future__ import annotations

from postmeter import roles
from postmeter.operators import volume
from postmeter.sources.tables import settled
from postmeter.plans.registry import EVENTS, POSTINGS, query


def _postings(spark, d):
    return roles.order_postings(spark, d)


def _settled(spark, d):
    """Postings for plans that read them in several branches."""
    return settled(roles.order_postings(spark, d).select("id", "entity", "publisher", "day", "segment"))


SERIES = """
win AS (SELECT entity, min(day) AS first_day, max(day) AS last_day FROM {p} GROUP BY 1),
spine AS (SELECT entity, first_day, last_day, CAST(unnest(generate_series(date_trunc('{u}', first_day), date_trunc('{u}', last_day), INTERVAL 1 {u})) AS DATE) AS start FROM win),
cnt AS (SELECT entity, CAST(date_trunc('{u}', day) AS DATE) AS start, count(*) AS n, count(DISTINCT publisher) AS p FROM {p} GROUP BY 1, 2),
series0 AS (SELECT s.entity, s.start, coalesce(n, 0) AS postings, coalesce(p, 0) AS publishers,
   CAST(s.start + INTERVAL 1 {u} - INTERVAL 1 DAY AS DATE) AS fin, first_day, last_day FROM spine s LEFT JOIN cnt c ON s.entity = c.entity AND s.start = c.start),
series1 AS (SELECT *, fin - start + 1 AS days_in_period, least(fin, last_day) - greatest(start, first_day) + 1 AS days_observed FROM series0),
series AS (SELECT *, days_observed < days_in_period AS is_partial,
   CASE WHEN days_observed >= 0.5::DOUBLE * days_in_period THEN 7.0::DOUBLE * postings / days_observed END AS ppw FROM series1)"""


def series_sql(unit: str, source: str = "postings") -> str:
    return SERIES.format(u=unit, p=source)


KEY = {"month": "strftime({0}, '%Y-%m')", "week": "strftime({0}, '%G-W%V')", "quarter": "(year({0}) || '-Q' || quarter({0}))"}


def _volume(unit: str, binding: str) -> str:
    return f"""WITH {binding}, {series_sql(unit)}
SELECT entity, start, {KEY[unit].format('start')} AS period, postings, publishers, CAST(days_in_period AS BIGINT) AS days_in_period, CAST(days_observed AS BIGINT) AS days_observed,
 is_partial, round(ppw, 6) AS postings_per_week FROM series"""


@query("trends_observation_window", f"WITH {POSTINGS} SELECT entity, min(day) AS first_day, max(day) AS last_day FROM postings_all GROUP BY 1")
def observation_window(spark, d):
    return volume.observation_window(roles.order_postings(spark, d))


@query("trends_volume_series_month", _volume("month", POSTINGS))
def volume_month(spark, d):
    return volume.volume_series(roles.order_postings(spark, d), "month")


@query("trends_volume_series_quarter", _volume("quarter", POSTINGS))
def volume_quarter(spark, d):
    return volume.volume_series(_postings(spark, d), "quarter")


@query("trends_volume_series_week", _volume("week", EVENTS))
def volume_week(spark, d):
    return volume.volume_series(roles.event_postings(spark, d), "week")


VELOCITY = f"""WITH {POSTINGS}, {series_sql('week')},
v AS (SELECT *, CASE WHEN NOT is_partial THEN ppw END AS v FROM series),
g AS (SELECT *, first_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base, lag(v) OVER w AS b,
  CASE WHEN v > 0 THEN ln(v) END AS l, avg(v) OVER (PARTITION BY entity ORDER BY start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rm FROM v WINDOW w AS (PARTITION BY entity ORDER BY start)),
h AS (SELECT *, CASE WHEN b <> 0 THEN 100 * (v / b - 1) END AS gp, l - lag(l) OVER (PARTITION BY entity ORDER BY start) AS lg FROM g)
SELECT entity, strftime(start, '%G-W%V') AS period, round(CASE WHEN base <> 0 THEN 100 * v / base END, 6) AS index_base_100, round(gp, 6) AS growth_pct, round(lg, 6) AS log_growth, round(rm, 6) AS rolling_mean,
  round(gp - lag(gp) OVER (PARTITION BY entity ORDER BY start), 6) AS acceleration FROM h"""


@query("trends_add_velocity", VELOCITY)
def add_velocity(spark, d):
    return volume.add_velocity(volume.volume_series(_postings(spark, d), "week")).select("entity", "period", "index_base_100", "growth_pct", "log_growth", "rolling_mean", "acceleration")


PRESENCE = "presence AS (SELECT entity, publisher, CAST(date_trunc('month', day) AS DATE) AS start, count(*) AS n FROM {p} WHERE publisher IS NOT NULL GROUP BY ALL), np AS (SELECT entity, count(DISTINCT start) AS periods FROM presence GROUP BY 1)"
PANEL = "panel AS (SELECT entity, publisher FROM presence JOIN np USING (entity) GROUP BY entity, publisher, periods HAVING count(*) >= ceil(0.75::DOUBLE * periods))"
PRES = PRESENCE.format(p="postings")


@query("trends_publisher_presence", f"WITH {POSTINGS}, {PRES} SELECT * FROM presence")
def presence(spark, d):
    return volume.publisher_presence(_postings(spark, d))


@query(
    "trends_publisher_panel",
    f"""WITH {POSTINGS}, {PRES} SELECT entity, publisher, CAST(sum(n) AS BIGINT) AS postings, count(*) AS periods_present, strftime(min(start), '%Y-%m') AS first_period, strftime(max(start), '%Y-%m') AS last_period,
 round(count(*) / periods::DOUBLE, 6) AS coverage_of_periods, count(*) = periods AS is_continuous FROM presence JOIN np USING (entity) GROUP BY entity, publisher, periods""",
)
def panel(spark, d):
    return volume.publisher_panel(_postings(spark, d))


@query("trends_panel_publishers", f"WITH {POSTINGS}, {PRES}, {PANEL} SELECT * FROM panel")
def panel_publishers(spark, d):
    return volume.panel_publishers(_postings(spark, d))


BALANCED = f"{PRES}, {PANEL}, onpanel AS (SELECT p.* FROM postings p SEMI JOIN panel USING (entity, publisher)), offpanel AS (SELECT * FROM postings WHERE entity NOT IN (SELECT entity FROM onpanel))"


def _balanced_sql() -> str:
    on, off = series_sql("month", "onpanel"), series_sql("month", "offpanel")
    for n in ("win", "spine", "cnt", "series0", "series1", "series"):
        import re

        on, off = re.sub(rf"\b{n}\b", f"{n}_on", on), re.sub(rf"\b{n}\b", f"{n}_off", off)
    return f"""{BALANCED}, {on}, {off},
balanced AS (SELECT entity, start, postings, publishers, days_in_period, days_observed, is_partial, ppw FROM series_on
 UNION ALL SELECT entity, start, 0, 0, days_in_period, days_observed, is_partial, 0.0::DOUBLE FROM series_off)"""


@query("trends_balanced_volume_series", f"WITH {POSTINGS}, {_balanced_sql()} SELECT entity, strftime(start, '%Y-%m') AS period, postings, publishers, is_partial, round(ppw, 6) AS postings_per_week FROM balanced")
def balanced(spark, d):
    return volume.balanced_volume_series(_postings(spark, d)).select("entity", "period", "postings", "publishers", "is_partial", "postings_per_week")


def _matched_sql(method: str) -> str:
    left = "lag(start) OVER w" if method == "chained" else "first_value(start) OVER w"
    index = """CASE WHEN max(CASE WHEN link IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN 100 * exp(sum(ln(link)) OVER w) END""" if method == "chained" else "100 * link"
    t = method[0]
    return f"""
{t}p AS (SELECT entity, start, row_number() OVER w AS pos_, {left} AS lft FROM (SELECT DISTINCT entity, start FROM presence) WINDOW w AS (PARTITION BY entity ORDER BY start)),
{t}q AS (SELECT entity, start, pos_, CASE WHEN pos_ > 1 THEN lft ELSE start END AS lft FROM {t}p),
{t}l AS (SELECT q.entity, q.start, q.pos_, count(b.n) AS matched, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS base, CAST(coalesce(sum(CASE WHEN b.n IS NOT NULL THEN c.n END), 0) AS BIGINT) AS cur
  FROM {t}q q LEFT JOIN presence c ON c.entity = q.entity AND c.start = q.start LEFT JOIN presence b ON b.entity = q.entity AND b.start = q.lft AND b.publisher = c.publisher GROUP BY ALL),
{t}k AS (SELECT *, CASE WHEN pos_ = 1 THEN 1.0::DOUBLE WHEN base > 0 THEN cur / base::DOUBLE END AS link FROM {t}l),
{method} AS (SELECT entity, start, {index} AS idx, matched, base, cur FROM {t}k WINDOW w AS (PARTITION BY entity ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


for _method in ("chained", "bilateral"):

    @query(
        f"trends_matched_index_{_method}",
        f"WITH {POSTINGS}, {PRES}, {_matched_sql(_method)} SELECT entity, start, strftime(start, '%Y-%m') AS period, round(idx, 6) AS index, matched AS matched_publishers, base AS base_postings, cur AS period_postings FROM {_method}",
    )
    def matched(spark, d, method=_method):
        return volume.matched_index(_settled(spark, d), "month", method)


_ALL = "PARTITION BY entity ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
SENSITIVITY = f"""{series_sql('month')}, {_balanced_sql()}, {_matched_sql('chained')}, {_matched_sql('bilateral')},
side AS (SELECT s.entity, s.start, s.postings AS raw_postings, s.publishers AS raw_publishers, s.is_partial, b.postings AS balanced_postings, c.idx AS chained_index, c.matched AS chained_matched, l.idx AS bilateral_index, l.matched AS bilateral_matched
 FROM series s LEFT JOIN balanced b USING (entity, start) LEFT JOIN chained c USING (entity, start) LEFT JOIN bilateral l USING (entity, start)),
sens AS (SELECT *, 100 * raw_postings / nullif(first_value(raw_postings) OVER ({_ALL}), 0)::DOUBLE AS raw_index, 100 * balanced_postings / nullif(first_value(balanced_postings IGNORE NULLS) OVER ({_ALL}), 0)::DOUBLE AS balanced_index FROM side)"""


@query(
    "trends_panel_sensitivity",
    f"""WITH {POSTINGS}, {SENSITIVITY} SELECT entity, strftime(start, '%Y-%m') AS period, raw_postings, raw_publishers, is_partial, balanced_postings, round(chained_index, 6) AS chained_index, chained_matched,
 round(bilateral_index, 6) AS bilateral_index, bilateral_matched, round(raw_index, 6) AS raw_index, round(balanced_index, 6) AS balanced_index FROM sens""",
)
def sensitivity(spark, d):
    return volume.panel_sensitivity(_settled(spark, d)).drop("start")


VERDICT = f"""{SENSITIVITY},
fin AS (SELECT entity, arg_max(round(raw_index, 2), start) FILTER (raw_index IS NOT NULL) AS raw_final, arg_max(round(balanced_index, 2), start) FILTER (balanced_index IS NOT NULL) AS balanced_final,
  arg_max(round(chained_index, 2), start) FILTER (chained_index IS NOT NULL) AS chained_final, arg_max(round(bilateral_index, 2), start) FILTER (bilateral_index IS NOT NULL) AS bilateral_final FROM sens GROUP BY 1),
lab AS (SELECT *, list_distinct(list_transform(list_filter([raw_final, balanced_final, chained_final, bilateral_final], lambda x: x IS NOT NULL), lambda x: CASE WHEN x > 110 THEN 'growth' WHEN x < 90 THEN 'decline' ELSE 'flat' END)) AS labels FROM fin),
verdict AS (SELECT entity, CASE WHEN len(labels) = 0 THEN 'unresolved' WHEN len(labels) = 1 THEN labels[1] WHEN NOT list_contains(labels, 'decline') THEN 'growth' WHEN NOT list_contains(labels, 'growth') THEN 'decline' ELSE 'unresolved' END AS direction,
 len(labels) = 1 AS treatments_agree, raw_final, balanced_final, chained_final, bilateral_final, round(greatest(raw_final, balanced_final, chained_final, bilateral_final) - least(raw_final, balanced_final, chained_final, bilateral_final), 6) AS spread FROM lab)"""


@query("trends_panel_verdict", f"WITH {POSTINGS}, {VERDICT} SELECT * FROM verdict")
def verdict(spark, d):
    return volume.panel_verdict(volume.panel_sensitivity(_settled(spark, d)))


def _middle(name: str, frame: str) -> str:
    return f"CASE WHEN count({name}) OVER {frame} >= 3 THEN median({name}) OVER {frame} END"


_NEAR = "(PARTITION BY entity ORDER BY start ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
SPIKES = f"""{series_sql('week')},
m AS (SELECT *, {_middle('CAST(postings AS DOUBLE)', _NEAR)} AS med FROM series),
dv AS (SELECT *, abs(postings - med) AS dev FROM m),
z AS (SELECT *, {_middle('dev', _NEAR)} AS mad FROM dv),
zz AS (SELECT *, 0.6745::DOUBLE * (postings - med) / nullif(mad, 0) AS rz, (postings - med) / sqrt(greatest(med, 1)) AS pz FROM z),
spikes AS (SELECT *, coalesce(rz >= 3.5 OR (rz IS NULL AND pz >= 3), FALSE) AS is_spike, coalesce(-rz >= 3.5 OR (rz IS NULL AND -pz >= 3), FALSE) AS is_trough FROM zz)"""


@query("trends_robust_spikes", f"WITH {POSTINGS}, {SPIKES} SELECT entity, strftime(start, '%G-W%V') AS period, postings, round(med, 6) AS local_median, round(rz, 6) AS robust_z, round(pz, 6) AS poisson_z, is_spike, is_trough FROM spikes")
def spikes(spark, d):
    return volume.robust_spikes(volume.volume_series(_postings(spark, d), "week")).select("entity", "period", "postings", "local_median", "robust_z", "poisson_z", "is_spike", "is_trough")


@query("trends_batch_table", f"WITH {EVENTS} SELECT entity, publisher, day, count(*) AS postings FROM postings GROUP BY ALL HAVING count(*) >= 3")
def batches(spark, d):
    return volume.batch_table(roles.event_postings(spark, d))


@query(
    "trends_batch_share",
    f"WITH {EVENTS}, b AS (SELECT entity, sum(n) AS n FROM (SELECT entity, count(*) AS n FROM postings GROUP BY entity, publisher, day HAVING count(*) >= 3) GROUP BY 1), t AS (SELECT entity, count(*) AS n FROM postings GROUP BY 1) SELECT entity, coalesce(b.n, 0)::BIGINT AS batch_postings, t.n AS postings, round(coalesce(b.n, 0) / t.n::DOUBLE, 6) AS share FROM t LEFT JOIN b USING (entity)",
)
def batch_share(spark, d):
    p = roles.event_postings(spark, d)
    return volume.batch_share(p, volume.batch_table(p))


ATTRIBUTE = f"""WITH {POSTINGS}, {SPIKES},
pres AS (SELECT entity, publisher, CAST(date_trunc('week', day) AS DATE) AS start, count(*) AS n FROM postings GROUP BY ALL),
dense AS (SELECT g.entity, g.publisher, s.start, coalesce(n, 0) AS n FROM (SELECT DISTINCT entity, publisher FROM pres) g JOIN spikes s USING (entity) LEFT JOIN pres p ON p.entity = g.entity AND p.publisher = g.publisher AND p.start = s.start),
typ AS (SELECT entity, publisher, quantile_cont(CAST(n AS DOUBLE), 0.5) AS typical FROM dense GROUP BY ALL),
sur AS (SELECT d.*, typical, greatest(n - typical, 0) AS surplus, row_number() OVER (PARTITION BY d.entity, d.start ORDER BY greatest(n - typical, 0) DESC, n DESC, d.publisher) AS pos_ FROM dense d JOIN typ USING (entity, publisher) JOIN (SELECT entity, start FROM spikes WHERE is_spike) USING (entity, start)),
dd AS (SELECT entity, start, max(n) AS big, count(DISTINCT publisher) AS pubs FROM (SELECT entity, publisher, day, CAST(date_trunc('week', day) AS DATE) AS start, count(*) AS n FROM postings GROUP BY ALL) GROUP BY ALL),
x AS (SELECT s.entity, strftime(s.start, '%G-W%V') AS period, s.postings, med, s.postings - med AS excess, t.publisher, t.n, typical, surplus, big, pubs FROM spikes s JOIN sur t ON t.entity = s.entity AND t.start = s.start AND pos_ = 1 JOIN dd ON dd.entity = s.entity AND dd.start = s.start WHERE is_spike),
y AS (SELECT *, CASE WHEN excess > 0 THEN surplus / excess END AS ex, CASE WHEN excess > 0 THEN big / excess END AS ds FROM x)
SELECT entity, period, postings, round(med, 6) AS local_median, round(excess, 6) AS excess, publisher AS top_publisher, n AS top_postings, round(typical, 6) AS top_typical, round(ex, 6) AS excess_explained, big AS largest_single_day, round(ds, 6) AS largest_day_share, pubs AS distinct_publishers,
 CASE WHEN coalesce(ex, 0) >= 0.5 OR coalesce(ds, 0) >= 0.4 THEN 'publisher_batch' ELSE 'broad_based' END AS verdict FROM y"""


@query("trends_attribute_spikes", ATTRIBUTE)
def attribute(spark, d):
    p = _settled(spark, d)
    return volume.attribute_spikes(p, volume.robust_spikes(volume.volume_series(p, "week")), "week")


@query(
    "trends_segment_series",
    f"""WITH {POSTINGS}, big AS (SELECT entity, segment FROM postings WHERE segment IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
e AS (SELECT entity, date_trunc('month', day) AS start, segment, count(*) AS postings FROM postings SEMI JOIN big USING (entity, segment) GROUP BY ALL)
SELECT entity, strftime(start, '%Y-%m') AS period, segment, postings, CAST(sum(postings) OVER (PARTITION BY entity, start) AS BIGINT) AS period_postings, round(postings / sum(postings) OVER (PARTITION BY entity, start)::DOUBLE, 6) AS share_of_period FROM e""",
)
def segments(spark, d):
    return volume.segment_series(_postings(spark, d))


def _segment_sql(source: str, panel: str) -> str:
    return f"""(WITH c AS (SELECT entity, segment, count(*) FILTER (month(day) <= 6) AS n_h1, count(*) FILTER (month(day) > 6) AS n_h2 FROM {source} GROUP BY ALL),
t AS (SELECT *, sum(n_h1) OVER (PARTITION BY entity) AS d1, sum(n_h2) OVER (PARTITION BY entity) AS d2 FROM c),
s AS (SELECT *, round(n_h1 / d1::DOUBLE, 4) AS share_h1, round(n_h2 / d2::DOUBLE, 4) AS share_h2 FROM t WHERE d1 > 0 AND d2 > 0 AND segment IS NOT NULL),
u AS (SELECT *, round(share_h2 - share_h1, 4) AS share_delta FROM s),
v AS (SELECT *, round(100 * (n_h2 / nullif(n_h1, 0)::DOUBLE - 1), 1) AS count_change_pct, round(100 * (share_delta / nullif(share_h1, 0)), 1) AS share_change_pct FROM u)
SELECT entity, segment, n_h1, n_h2, share_h1, share_h2, share_delta, count_change_pct, share_change_pct, CASE WHEN n_h1 + n_h2 < 10 THEN 'insufficient_support' WHEN share_change_pct >= 25 THEN 'growth' WHEN share_change_pct <= -25 THEN 'decline' ELSE 'stable' END AS direction, '{panel}' AS panel FROM v)"""


@query("trends_segment_trend", f"WITH {POSTINGS} SELECT * FROM {_segment_sql('postings', 'raw')}")
def segment_trend(spark, d):
    return volume.segment_trend(_settled(spark, d))


@query(
    "trends_compare_panels",
    f"""WITH {POSTINGS}, {BALANCED}, r AS {_segment_sql('postings', 'raw')}, b AS {_segment_sql('onpanel', 'balanced')}
SELECT r.*, b.n_h1 AS n_h1_balanced, b.n_h2 AS n_h2_balanced, b.share_change_pct AS share_change_pct_balanced, coalesce(b.direction, 'no_panel') AS direction_balanced, r.direction = coalesce(b.direction, 'no_panel') AS directions_agree FROM r LEFT JOIN b USING (entity, segment)""",
)
def compare_panels(spark, d):
    return volume.compare_panels(_settled(spark, d))


@query(
    "trends_seasonality",
    f"""WITH {POSTINGS}, size AS (SELECT entity, count(*) AS total, count(DISTINCT date_trunc('week', day)) AS weeks, (max(day) - min(day)) / 365.25::DOUBLE AS years FROM postings_all GROUP BY 1),
lv AS (SELECT 'day_of_week' AS cycle, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][k] AS level, k, 7 AS levels FROM range(1, 8) t(k) UNION ALL SELECT 'month_of_year', lpad(k::VARCHAR, 2, '0'), k, 12 FROM range(1, 13) t(k)),
c AS (SELECT entity, 'day_of_week' AS cycle, isodow(day) AS k, count(*) AS n FROM postings_all GROUP BY ALL UNION ALL SELECT entity, 'month_of_year', month(day), count(*) FROM postings_all GROUP BY ALL)
SELECT s.entity, lv.cycle, level, coalesce(n, 0) AS postings, round(coalesce(n, 0) / total::DOUBLE, 6) AS share, round(1 / levels::DOUBLE, 6) AS expected_share, round(levels * coalesce(n, 0) / total::DOUBLE, 6) AS index_vs_uniform,
 CAST(CASE WHEN lv.cycle = 'day_of_week' THEN weeks ELSE floor(years) END AS BIGINT) AS observations_per_level, CASE WHEN lv.cycle = 'day_of_week' THEN weeks ELSE floor(years) END >= 2 AS identifiable
FROM size s CROSS JOIN lv LEFT JOIN c ON c.entity = s.entity AND c.cycle = lv.cycle AND c.k = lv.k""",
)
def seasonality(spark, d):
    return volume.seasonality(roles.order_postings(spark, d))


@query("trends_weekend_share", f"WITH {POSTINGS} SELECT entity, round(avg(CASE WHEN isodow(day) >= 6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS weekend_share FROM postings_all GROUP BY 1")
def weekend(spark, d):
    return volume.weekend_share(roles.order_postings(spark, d))
