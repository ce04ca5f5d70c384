"""Delete-one replicates against runs without the publisher."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from postmeter.operators import compare, forecast, replicates


@pytest.fixture(scope="module")
def postings(spark):
    """Three entities on five shared publishers (one of which holds a third of all) over 20 months, a share that moves, and a publisher of one entity."""
    rng = random.Random(3)
    rows, n = [], 0
    for month in range(20):
        day = datetime.date(2020 + month // 12, month % 12 + 1, 5)
        for p, size in (("a", 40), ("b", 12), ("c", 12), ("d", 10), ("e", 9)):
            for _ in range(size):
                # the first publisher holds entity x up as its share falls
                e = "x" if rng.random() < (0.5 if p == "a" else 0.6 - 0.02 * month) else rng.choice("yz")
                rows.append((n := n + 1, e, p, day))
        if month == 7:
            rows = [r for r in rows if r[3] != day or r[2] == "a"]  # a month that one publisher serves alone
    rows += [(n + 1, "x", "own", datetime.date(2020, 3, 1)), (n + 2, "y", None, datetime.date(2020, 3, 1))]
    return spark.createDataFrame(rows, "id int, entity string, publisher string, day date").cache()


def test_every_replicate_is_a_run_without_its_publisher(spark, postings):
    base = forecast.panel_share_series(postings)
    all_series = replicates.series_without_each(base, replicates.panel_cells(postings)).cache()
    gate = {(r.dropped, r.key): r for r in replicates.gate_without_each(all_series).collect()}
    verdicts = {r.dropped: r for r in replicates.verdicts_without_each(all_series, "x").collect()}
    assert set(verdicts) == {"(none)", "a", "b", "c", "d", "e"}
    gone = {r[0] for r in forecast.unobserved_periods(postings).collect()}
    for dropped, got in verdicts.items():
        # a panel of given publishers; which periods the data observe at all is a matter of all postings
        cut = compare.restrict(postings, compare.common_publishers(postings)).filter(F.col("publisher") != dropped)
        keys, starts = cut.select(F.col("entity").alias("key")).distinct(), base.select("start").distinct()
        n = cut.groupBy(F.col("entity").alias("key"), F.trunc("day", "MM").alias("start")).agg(F.count("*").alias("numerator"))
        grid = keys.crossJoin(starts).join(n, ["key", "start"], "left").na.fill(0)
        total = grid.groupBy("start").agg(F.sum("numerator").alias("denominator"))
        series = grid.join(total, "start").withColumns({"share": F.try_divide("numerator", "denominator"), "is_observed": (F.col("denominator") > 0) & ~F.col("start").isin(*gone or [None])}).cache()
        series = series.withColumn("is_observed", F.coalesce("is_observed", F.lit(True))).cache()
        own = {r.key: r for r in forecast.forecastability(series).collect()}
        for key, r in own.items():
            g = gate[(dropped, key)]
            assert (g.n_observed, g.min_cell, g.verdict) == (r.n_observed, r.min_cell, r.verdict) and g.homogeneity_p == pytest.approx(r.homogeneity_p, abs=1e-12)
        passing = sorted(k for k, r in own.items() if r.verdict == "forecastable")
        tested = forecast.backtest(series).cache()
        duel = forecast.contest(tested.filter("horizon = 1")).collect()
        table = forecast.horizons(tested.filter(F.col("key").isin(*passing or [""])))
        first = table.filter("horizon = 1").first()
        assert got.forecastable == ", ".join(passing) and got.any_model_beats_naive == any(r.beats_benchmark for r in duel)
        assert got.smallest_p_value == pytest.approx(min(r.p_value for r in duel), abs=1e-9)
        assert got.max_useful_horizon == forecast.horizon_verdict(table).first().max_useful_horizon
        assert (got.h1_interval_factor is None) == (first is None or first.interval_factor is None)
        if got.h1_interval_factor is not None:
            assert got.h1_interval_factor == pytest.approx(first.interval_factor, rel=1e-9)
        shares = [r.share for r in series.filter("key = 'x' and is_observed").collect()]
        mean = sum(shares) / len(shares)
        assert got.focus_max_share == pytest.approx(max(shares)) and got.focus_largest_move_pp == pytest.approx(100 * max(abs(s - mean) for s in shares))
        assert got.n_publishers == (5 if dropped == "(none)" else 4)
    assert verdicts["(none)"].verdict_unchanged
    assert any(v.forecastable for v in verdicts.values())


def test_no_postings(spark, postings):
    none = postings.limit(0)
    series = replicates.series_without_each(forecast.panel_share_series(none), replicates.panel_cells(none))
    assert series.count() == 0 and replicates.verdicts_without_each(series, "x").count() == 0


def test_planted_trend_is_forecast(spark):
    """A share that falls steadily passes the gate, beats the benchmark in no tie, and gives rows with intervals."""
    rows = [(f"2020-{m:02d}-01" if m < 13 else f"2021-{m - 12:02d}-01", k, n) for m in range(1, 21) for k, n in (("x", 400 - 12 * m), ("y", 400 + 12 * m))]
    series = spark.createDataFrame(rows, "start string, key string, numerator long").selectExpr("key", "cast(start as date) start", "numerator", "800L denominator", "numerator / 800 share", "true is_observed").cache()
    gate = forecast.forecastability(series)
    assert {r.verdict for r in gate.collect()} == {"forecastable"}
    tested = forecast.backtest(series).cache()
    selection = {r.key: r for r in forecast.select_model(tested).collect()}
    assert selection["x"].selected != "naive" and selection["x"].selected_by == "beats_benchmark"
    made = forecast.forecast(series, forecast.select_model(tested), tested, gate).collect()
    assert len(made) == 6 and all(r.lo_share <= r.hi_share for r in made if r.lo_share is not None)
    steps = [r.point_share for r in sorted(made, key=lambda r: r.horizon) if r.key == "x"]
    assert steps == sorted(steps, reverse=True) and steps[0] < 400 - 12 * 20 + 1
