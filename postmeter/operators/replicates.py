"""Delete-one replicates: what gate, contest and horizon say when each publisher of the common panel is left out in turn.

Postings are reduced once to (publisher, key, period). A replicate is the panel's totals less one publisher's cells, so no posting is
read again; a replicate's name goes into the key of its series, and gate, backtest, contest and horizon run for all replicates in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.functions.periods import check_period, start_of
from postmeter.functions.stats import ratio
from postmeter.operators import compare, forecast
from postmeter.sources.tables import settled

#: The replicate that leaves nobody out, and what stands between a replicate's name and a key.
PUBLISHED_PANEL, BETWEEN = "(none)", "\x1f"


def panel_cells(postings: DataFrame, period: str = "month") -> DataFrame:
    """publisher, key, start, n: postings of the common panel, reduced once."""
    cut = compare.restrict(postings, compare.common_publishers(postings))
    return cut.groupBy("publisher", F.col("entity").alias("key"), start_of(F.col("day"), check_period(period)).alias("start")).agg(F.count("*").alias("n"))


def series_without_each(base: DataFrame, cells: DataFrame) -> DataFrame:
    """dropped, key, start, numerator, denominator, share, is_observed: base (the panel's series) and base less every publisher's cells.

    A publisher of the common panel carries every key, so the join by key deals it the whole grid. Periods that nobody else serves
    are unobserved in its replicate; which periods the data observe at all stays as in base."""
    columns = ("dropped", "key", "start", "numerator", "denominator", "share", "is_observed")
    own = cells.select(F.col("publisher").alias("dropped"), "key", "start", "n")
    pool = own.groupBy("dropped", "start").agg(F.sum("n").alias("gone"))
    grid = own.select("dropped", "key").distinct().join(base, "key").join(own, ["dropped", "key", "start"], "left").join(pool, ["dropped", "start"], "left")
    less = lambda c, by: F.col(c) - F.coalesce(by, F.lit(0))
    out = grid.withColumns({"numerator": less("numerator", "n"), "denominator": less("denominator", "gone")})
    out = out.withColumns({"share": ratio(F.col("numerator"), F.col("denominator")), "is_observed": F.col("is_observed") & (F.col("denominator") > 0)})
    return base.withColumn("dropped", F.lit(PUBLISHED_PANEL)).select(*columns).unionByName(out.select(*columns))


def _joined(dropped: Column, key: Column) -> Column:
    return F.concat_ws(BETWEEN, dropped, key)


def _parts(df: DataFrame) -> DataFrame:
    """df with the replicate's name beside the key that holds it."""
    return df.withColumn("dropped", F.split_part("key", F.lit(BETWEEN), F.lit(1)))


def gate_without_each(series: DataFrame, **floors) -> DataFrame:
    """The gate of every replicate: dropped, key and the columns of forecast.forecastability. floors: its limits."""
    gate = forecast.forecastability(series.withColumn("key", _joined(F.col("dropped"), F.col("key"))), **floors)
    return _parts(gate).withColumn("key", F.split_part("key", F.lit(BETWEEN), F.lit(2)))


def verdicts_without_each(series: DataFrame, focus: str, models=tuple(forecast.MODELS), **floors) -> DataFrame:
    """A row a replicate: the keys that pass the gate, whether a model beats the benchmark one step ahead and the least p-value, the width of
    the one-step interval and the longest useful horizon over the passing keys, the focus key's largest share and its largest distance (in
    points) from its mean, and whether what the published panel says still holds.

    Replicates without an observed period have nulls and horizon 0; publishers are as many as there are replicates besides the published panel."""
    gate = settled(gate_without_each(series, **floors))
    passing = gate.filter("verdict = 'forecastable'").select("dropped", "key")
    tested = settled(_parts(forecast.backtest(series.withColumn("key", _joined(F.col("dropped"), F.col("key"))), models)))
    keys = gate.groupBy("dropped").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("verdict") == "forecastable", F.col("key")))), ", ").alias("forecastable"))
    duel = forecast.contest(tested.filter("horizon = 1"), ["dropped"]).groupBy("dropped").agg(F.bool_or("beats_benchmark").alias("any_model_beats_naive"), F.min("p_value").alias("smallest_p_value"))
    table = forecast.horizons(tested.join(passing.withColumn("key", _joined(F.col("dropped"), F.col("key"))), ["dropped", "key"], "left_semi"), by=("dropped",))
    width = table.filter("horizon = 1").select("dropped", F.col("interval_factor").alias("h1_interval_factor"))
    useful = forecast.horizon_verdict(table, by=("dropped",)).select("dropped", "max_useful_horizon")
    seen = series.filter((F.col("key") == focus) & F.col("is_observed")).groupBy("dropped")
    moves = seen.agg(F.max("share").alias("focus_max_share"), (100 * F.greatest(F.max("share") - F.avg("share"), F.avg("share") - F.min("share"))).alias("focus_largest_move_pp"))
    size = series.agg((F.countDistinct("dropped") - 1).alias("publishers"))
    out = keys.join(duel, "dropped", "left").join(width, "dropped", "left").join(useful, "dropped", "left").join(moves, "dropped", "left").join(F.broadcast(size))
    out = settled(out.withColumns({
        "any_model_beats_naive": F.coalesce("any_model_beats_naive", F.lit(False)), "max_useful_horizon": F.coalesce("max_useful_horizon", F.lit(0)),
        "n_publishers": F.when(F.col("dropped") == PUBLISHED_PANEL, F.col("publishers")).otherwise(F.col("publishers") - 1),
    }).drop("publishers"))
    base = out.filter(F.col("dropped") == PUBLISHED_PANEL).select(F.struct("forecastable", "any_model_beats_naive", "max_useful_horizon").alias("said"))
    return out.join(F.broadcast(base)).withColumn("verdict_unchanged", F.struct("forecastable", "any_model_beats_naive", "max_useful_horizon") == F.col("said")).drop("said")
