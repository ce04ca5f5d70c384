"""Volume, velocity, publisher panels, spikes and seasonality, for every entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions.periods import STEPS, check_period, end_of, half_of, key_of, start_of
from postmeter.functions.stats import ratio


def observation_window(postings: DataFrame) -> DataFrame:
    """entity, first_day, last_day."""
    return postings.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def calendar(windows: DataFrame, period: str) -> DataFrame:
    """Every period that an entity's window touches: entity, start, first_day, last_day."""
    days = F.sequence(start_of(F.col("first_day"), period), start_of(F.col("last_day"), period), F.expr(STEPS[check_period(period)]))
    return windows.withColumn("start", F.explode(days))


def volume_series(postings: DataFrame, period: str = "month", min_observed: float = 0.5) -> DataFrame:
    """Zero-filled periods with exposure; postings_per_week is null where less than min_observed of a period was observed."""
    counts = postings.withColumn("start", start_of(F.col("day"), period)).groupBy("entity", "start").agg(F.count("*").alias("n"), F.countDistinct("publisher").alias("p"))
    out = calendar(observation_window(postings), period).join(counts, ["entity", "start"], "left")
    end = end_of(F.col("start"), period)
    full = F.datediff(end, "start") + 1
    seen = F.datediff(F.least(end, F.col("last_day")), F.greatest("start", "first_day")) + 1
    out = out.select("entity", "start", key_of(F.col("start"), period).alias("period"), F.coalesce("n", F.lit(0)).alias("postings"), F.coalesce("p", F.lit(0)).alias("publishers"), full.cast("long").alias("days_in_period"), seen.cast("long").alias("days_observed"))
    rate = F.when(F.col("days_observed") >= min_observed * F.col("days_in_period"), 7.0 * F.col("postings") / F.col("days_observed"))
    return out.withColumns({"is_partial": F.col("days_observed") < F.col("days_in_period"), "postings_per_week": rate})


def add_velocity(series: DataFrame, value: str = "postings_per_week", window: int = 3) -> DataFrame:
    """series plus index (first complete period is 100), growth_pct, log_growth, rolling_mean and acceleration; partial periods are gaps."""
    w = Window.partitionBy("entity").orderBy("start")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = series.withColumn("_v", F.when(~F.col("is_partial"), F.col(value)))
    before = F.lag("_v").over(w)
    positive = F.when(F.col("_v") > 0, F.ln("_v"))
    out = out.withColumns(
        {
            "index_base_100": 100 * ratio(F.col("_v"), F.first("_v", ignorenulls=True).over(so_far)),
            "growth_pct": 100 * (ratio(F.col("_v"), before) - 1),
            "log_growth": positive - F.lag(positive).over(w),
            "rolling_mean": F.avg("_v").over(w.rowsBetween(1 - window, 0)),
        }
    )
    return out.withColumn("acceleration", F.col("growth_pct") - F.lag("growth_pct").over(w)).drop("_v")


def publisher_presence(postings: DataFrame, period: str = "month") -> DataFrame:
    """entity, publisher, start, n: the panel in long form."""
    return postings.filter("publisher is not null").groupBy("entity", "publisher", start_of(F.col("day"), period).alias("start")).agg(F.count("*").alias("n"))


def publisher_panel(postings: DataFrame, period: str = "month") -> DataFrame:
    """Entry, exit and continuity of every publisher of an entity."""
    presence = publisher_presence(postings, period)
    periods = presence.groupBy("entity").agg(F.countDistinct("start").alias("periods"))
    each = presence.groupBy("entity", "publisher").agg(F.sum("n").alias("postings"), F.count("*").alias("periods_present"), F.min("start").alias("first"), F.max("start").alias("last"))
    out = each.join(periods, "entity")
    return out.select(
        "entity", "publisher", "postings", "periods_present", key_of(F.col("first"), period).alias("first_period"), key_of(F.col("last"), period).alias("last_period"),
        ratio(F.col("periods_present"), F.col("periods")).alias("coverage_of_periods"), (F.col("periods_present") == F.col("periods")).alias("is_continuous"),
    )


def panel_publishers(postings: DataFrame, period: str = "month", min_share: float = 0.75, min_periods: int | None = None) -> DataFrame:
    """entity, publisher of those present in enough of the entity's observed periods."""
    presence = publisher_presence(postings, period)
    periods = presence.groupBy("entity").agg(F.countDistinct("start").alias("periods"))
    need = F.lit(min_periods) if min_periods is not None else F.ceil(min_share * F.col("periods"))
    each = presence.groupBy("entity", "publisher").agg(F.count("*").alias("present"))
    return each.join(periods, "entity").filter(F.col("present") >= need).select("entity", "publisher")


def on_panel(postings: DataFrame, period: str = "month", min_share: float = 0.75) -> DataFrame:
    return postings.join(panel_publishers(postings, period, min_share), ["entity", "publisher"], "left_semi")


def balanced_volume_series(postings: DataFrame, period: str = "month", min_share: float = 0.75) -> DataFrame:
    """volume_series of panel publishers, over the window of their own postings; an entity without a panel keeps its calendar at zero."""
    kept = on_panel(postings, period, min_share)
    found = volume_series(kept, period)
    none = postings.join(kept.select("entity").distinct(), "entity", "left_anti")
    zero = volume_series(none, period).withColumns({"postings": F.lit(0).cast("long"), "publishers": F.lit(0).cast("long"), "postings_per_week": F.lit(0.0)})
    return found.unionByName(zero)


def matched_index(postings: DataFrame, period: str = "month", method: str = "chained") -> DataFrame:
    """Index over publishers present on both sides of every link. A link without a base is null and, when chained, stays so."""
    if method not in ("chained", "bilateral"):
        raise ValueError(f"unknown method {method!r}")
    presence = publisher_presence(postings, period)
    order = Window.partitionBy("entity").orderBy("start")
    periods = presence.select("entity", "start").distinct().withColumn("at", F.row_number().over(order))
    base = F.first("start").over(order.rowsBetween(Window.unboundedPreceding, 0)) if method == "bilateral" else F.lag("start").over(order)
    periods = periods.withColumn("left", F.when(F.col("at") > 1, base).otherwise(F.col("start")))
    current = presence.join(periods, ["entity", "start"])
    left = presence.select("entity", "publisher", F.col("start").alias("left"), F.col("n").alias("n_left"))
    links = current.join(left, ["entity", "publisher", "left"]).groupBy("entity", "start").agg(F.count("*").alias("matched"), F.sum("n_left").alias("base"), F.sum("n").alias("now"))
    out = periods.join(links, ["entity", "start"], "left").withColumn("link", F.when(F.col("at") == 1, F.lit(1.0)).otherwise(ratio(F.col("now"), F.col("base"))))
    if method == "chained":
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        broken = F.max(F.col("link").isNull().cast("int")).over(upto)
        index = F.when(broken == 0, 100 * F.exp(F.sum(F.ln("link")).over(upto)))
    else:
        index = 100 * F.col("link")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.withColumn("index", index).select("entity", "start", key_of(F.col("start"), period).alias("period"), "index", zero("matched").alias("matched_publishers"), zero("base").alias("base_postings"), zero("now").alias("period_postings"))


def _index_100(value: str) -> Column:
    every = Window.partitionBy("entity").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return 100 * ratio(F.col(value), F.first(value, ignorenulls=True).over(every))


def panel_sensitivity(postings: DataFrame, period: str = "month", min_share: float = 0.75) -> DataFrame:
    """Raw, balanced, chained and bilateral index side by side, for every entity and period."""
    raw = volume_series(postings, period).select("entity", "start", "period", F.col("postings").alias("raw_postings"), F.col("publishers").alias("raw_publishers"), "is_partial")
    balanced = balanced_volume_series(postings, period, min_share).select("entity", "start", F.col("postings").alias("balanced_postings"))
    out = raw.join(balanced, ["entity", "start"], "left")
    for method in ("chained", "bilateral"):
        m = matched_index(postings, period, method).select("entity", "start", F.col("index").alias(f"{method}_index"), F.col("matched_publishers").alias(f"{method}_matched"))
        out = out.join(m, ["entity", "start"], "left")
    return out.withColumns({"raw_index": _index_100("raw_postings"), "balanced_index": _index_100("balanced_postings")})


TREATMENTS = ("raw", "balanced", "chained", "bilateral")


def panel_verdict(sensitivity: DataFrame, flat_band: float = 10.0) -> DataFrame:
    """entity, direction, treatments_agree, the last known index of each treatment and their spread."""
    last = [F.max_by(F.round(f"{t}_index", 2), F.when(F.col(f"{t}_index").isNotNull(), F.col("start"))).alias(f"{t}_final") for t in TREATMENTS]
    out = sensitivity.groupBy("entity").agg(*last)
    label = lambda c: F.when(c > 100 + flat_band, "growth").when(c < 100 - flat_band, "decline").when(c.isNotNull(), "flat")
    finals = F.array_compact(F.array(*(F.col(f"{t}_final") for t in TREATMENTS)))
    out = out.withColumn("_labels", F.array_distinct(F.array_compact(F.array(*(label(F.col(f"{t}_final")) for t in TREATMENTS)))))
    has = lambda x: F.array_contains("_labels", x)
    direction = F.when(F.size("_labels") == 0, "unresolved").when(F.size("_labels") == 1, F.get("_labels", F.lit(0))).when(~has("decline"), "growth").when(~has("growth"), "decline").otherwise("unresolved")
    return out.select("entity", direction.alias("direction"), (F.size("_labels") == 1).alias("treatments_agree"), *(f"{t}_final" for t in TREATMENTS), (F.array_max(finals) - F.array_min(finals)).alias("spread"))


def robust_spikes(series: DataFrame, value: str = "postings", window: int = 9, threshold: float = 3.5, poisson: float = 3.0) -> DataFrame:
    """series plus local_median, robust_z, poisson_z, is_spike and is_trough from centred medians and absolute deviations."""
    side = window // 2
    near = Window.partitionBy("entity").orderBy("start").rowsBetween(-side, side)

    def middle(values: Column) -> Column:
        s = F.sort_array(values)
        n = F.size(s)
        return F.when(n >= 3, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)

    out = series.withColumn("_v", F.col(value).cast("double"))
    out = out.withColumn("_list", F.collect_list("_v").over(near)).withColumn("local_median", middle(F.col("_list")))
    out = out.withColumn("_list", F.collect_list(F.abs(F.col("_v") - F.col("local_median"))).over(near)).withColumn("_mad", middle(F.col("_list")))
    off = F.col("_v") - F.col("local_median")
    out = out.withColumns({"robust_z": 0.6745 * ratio(off, F.col("_mad")), "poisson_z": off / F.sqrt(F.greatest("local_median", F.lit(1.0)))})

    def beyond(sign: int) -> Column:
        r, p = sign * F.col("robust_z"), sign * F.col("poisson_z")
        return F.coalesce((r >= threshold) | (r.isNull() & (p >= poisson)), F.lit(False))

    return out.withColumns({"is_spike": beyond(1), "is_trough": beyond(-1)}).drop("_v", "_list", "_mad")


def batch_table(postings: DataFrame, min_batch: int = 3) -> DataFrame:
    """Publisher-days with at least min_batch postings of an entity."""
    days = postings.filter("publisher is not null and day is not null").groupBy("entity", "publisher", "day").agg(F.count("*").alias("postings"))
    return days.filter(F.col("postings") >= min_batch)


def attribute_spikes(postings: DataFrame, spikes: DataFrame, period: str = "week", excess_threshold: float = 0.5, day_threshold: float = 0.4) -> DataFrame:
    """For every spike: the publisher with the largest surplus over its own median, its share of the excess, the largest publisher-day, a verdict."""
    presence = publisher_presence(postings, period)
    grid = presence.select("entity", "publisher").distinct().join(spikes.select("entity", "start"), "entity")
    dense = grid.join(presence, ["entity", "publisher", "start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    typical = dense.groupBy("entity", "publisher").agg(F.expr("percentile(n, 0.5)").alias("typical"))
    flagged = spikes.filter("is_spike").select("entity", "start", "period", "postings", "local_median")
    surplus = dense.join(flagged.select("entity", "start"), ["entity", "start"]).join(typical, ["entity", "publisher"])
    surplus = surplus.withColumn("surplus", F.greatest(F.col("n") - F.col("typical"), F.lit(0.0)))
    first = Window.partitionBy("entity", "start").orderBy(F.desc("surplus"), F.desc("n"), "publisher")
    top = surplus.withColumn("_at", F.row_number().over(first)).filter("_at = 1")
    days = batch_table(postings, 1).withColumn("start", start_of(F.col("day"), period)).groupBy("entity", "start").agg(F.max("postings").alias("largest_single_day"), F.countDistinct("publisher").alias("distinct_publishers"))
    out = flagged.join(top.select("entity", "start", "publisher", "n", "typical", "surplus"), ["entity", "start"]).join(days, ["entity", "start"], "left")
    excess = F.col("postings") - F.col("local_median")
    share = lambda c: F.when(excess > 0, c / excess)
    out = out.withColumns({"excess": excess, "excess_explained": share(F.col("surplus")), "largest_day_share": share(F.col("largest_single_day"))})
    batch = (F.coalesce("excess_explained", F.lit(0.0)) >= excess_threshold) | (F.coalesce("largest_day_share", F.lit(0.0)) >= day_threshold)
    return out.select("entity", "period", "postings", "local_median", "excess", F.col("publisher").alias("top_publisher"), F.col("n").alias("top_postings"), F.col("typical").alias("top_typical"), "excess_explained", "largest_single_day", "largest_day_share", "distinct_publishers", F.when(batch, "publisher_batch").otherwise("broad_based").alias("verdict"))


def segment_series(postings: DataFrame, period: str = "month", min_postings: int = 10) -> DataFrame:
    """entity, period, segment, postings and share of the period, over segments with at least min_postings."""
    big = postings.groupBy("entity", "segment").count().filter((F.col("count") >= min_postings) & F.col("segment").isNotNull())
    each = postings.join(big, ["entity", "segment"], "left_semi").groupBy("entity", start_of(F.col("day"), period).alias("start"), "segment").agg(F.count("*").alias("postings"))
    total = F.sum("postings").over(Window.partitionBy("entity", "start"))
    return each.withColumn("period_postings", total).select("entity", key_of(F.col("start"), period).alias("period"), "segment", "postings", "period_postings", ratio(F.col("postings"), F.col("period_postings")).alias("share_of_period"))


def segment_trend(postings: DataFrame, panel: str = "raw", min_postings: int = 10, threshold: float = 0.25, min_share: float = 0.75) -> DataFrame:
    """Each segment's half-year counts and shares, and its direction by change of share, on all or on panel publishers."""
    if panel not in ("raw", "balanced"):
        raise ValueError(f"unknown panel {panel!r}")
    block = postings if panel == "raw" else on_panel(postings, "month", min_share)
    half = half_of(F.col("day"))
    out = block.groupBy("entity", "segment").agg(F.count(F.when(half == "h1", 1)).alias("n_h1"), F.count(F.when(half == "h2", 1)).alias("n_h2"))
    every = Window.partitionBy("entity")
    out = out.withColumns({"d1": F.sum("n_h1").over(every), "d2": F.sum("n_h2").over(every)}).filter("d1 > 0 and d2 > 0 and segment is not null")
    out = out.withColumns({"share_h1": F.round(F.col("n_h1") / F.col("d1"), 4), "share_h2": F.round(F.col("n_h2") / F.col("d2"), 4)})
    out = out.withColumn("share_delta", F.round(F.col("share_h2") - F.col("share_h1"), 4))
    out = out.withColumns({"count_change_pct": F.round(100 * (ratio(F.col("n_h2"), F.col("n_h1")) - 1), 1), "share_change_pct": F.round(100 * ratio(F.col("share_delta"), F.col("share_h1")), 1)})
    change = F.col("share_change_pct")
    direction = F.when(F.col("n_h1") + F.col("n_h2") < min_postings, "insufficient_support").when(change >= 100 * threshold, "growth").when(change <= -100 * threshold, "decline").otherwise("stable")
    return out.withColumns({"direction": direction, "panel": F.lit(panel)}).drop("d1", "d2")


def compare_panels(postings: DataFrame, **options) -> DataFrame:
    """Segment trends on all and on panel publishers, and whether their directions agree."""
    raw = segment_trend(postings, "raw", **options)
    b = segment_trend(postings, "balanced", **options).select("entity", "segment", *(F.col(c).alias(f"{c}_balanced") for c in ("n_h1", "n_h2", "share_change_pct", "direction")))
    out = raw.join(b, ["entity", "segment"], "left").withColumn("direction_balanced", F.coalesce("direction_balanced", F.lit("no_panel")))
    return out.withColumn("directions_agree", F.col("direction") == F.col("direction_balanced"))


DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def seasonality(postings: DataFrame, min_cycles: int = 2) -> DataFrame:
    """Day-of-week and month-of-year profiles with the number of cycles each level was seen in, and whether that identifies it."""
    dated = postings.filter("day is not null")
    size = dated.groupBy("entity").agg(F.count("*").alias("total"), F.countDistinct(F.trunc("day", "WEEK")).alias("weeks"), (F.datediff(F.max("day"), F.min("day")) / 365.25).alias("years"))
    levels = [("day_of_week", n, k, 7) for k, n in enumerate(DAYS)] + [("month_of_year", f"{m:02d}", m, 12) for m in range(1, 13)]
    grid = F.explode(F.array(*(F.struct(F.lit(c).alias("cycle"), F.lit(n).alias("level"), F.lit(k).alias("k"), F.lit(s).alias("levels")) for c, n, k, s in levels)))
    spine = size.withColumn("g", grid).select("entity", "total", "weeks", "years", "g.*")
    both = F.explode(F.array(F.struct(F.lit("day_of_week").alias("cycle"), F.weekday("day").alias("k")), F.struct(F.lit("month_of_year").alias("cycle"), F.month("day").alias("k"))))
    counts = dated.select("entity", both.alias("b")).groupBy("entity", "b.cycle", "b.k").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    seen = F.when(F.col("cycle") == "day_of_week", F.col("weeks")).otherwise(F.floor("years"))
    out = spine.join(counts, ["entity", "cycle", "k"], "left")
    return out.select("entity", "cycle", "level", n.alias("postings"), (n / F.col("total")).alias("share"), (1 / F.col("levels")).alias("expected_share"), (F.col("levels") * n / F.col("total")).alias("index_vs_uniform"), seen.alias("observations_per_level"), (seen >= min_cycles).alias("identifiable"))


def weekend_share(postings: DataFrame) -> DataFrame:
    return postings.filter("day is not null").groupBy("entity").agg(F.avg((F.weekday("day") >= 5).cast("double")).alias("weekend_share"))


def batch_share(postings: DataFrame, batches: DataFrame) -> DataFrame:
    """entity, batch_postings, postings, share: how much of an entity's postings came in batches of one publisher and day."""
    b = batches.groupBy("entity").agg(F.sum("postings").alias("batch_postings"))
    out = postings.groupBy("entity").agg(F.count("*").alias("postings")).join(b, "entity", "left")
    return out.select("entity", F.coalesce("batch_postings", F.lit(0)).alias("batch_postings"), "postings", (F.coalesce("batch_postings", F.lit(0)) / F.col("postings")).alias("share"))
