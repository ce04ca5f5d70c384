"""Like-for-like comparison between entities: common panels, shares, standardisation, proportions, false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions.periods import half_of, key_of, start_of
from postmeter.functions.stats import benjamini_hochberg, newcombe, ratio, two_proportion_p, wilson
from postmeter.operators import text, volume
from postmeter.operators.items import denominator, of_base, tally
from postmeter.roles import EXCLUDED_SEGMENTS

MIN_CELL = 10
MIN_COMMON_SHARE = 0.40


def _entities(postings: DataFrame) -> DataFrame:
    return postings.select("entity").distinct()


def common_publishers(postings: DataFrame, min_postings: int = 1) -> DataFrame:
    """Publishers that carry every entity: relational division by counting."""
    cells = postings.filter("publisher is not null").groupBy("publisher", "entity").count().filter(F.col("count") >= min_postings)
    every = _entities(postings).agg(F.count("*").alias("wanted"))
    return cells.groupBy("publisher").agg(F.count("*").alias("carried")).join(F.broadcast(every), F.col("carried") == F.col("wanted")).select("publisher")


def restrict(postings: DataFrame, publishers: DataFrame) -> DataFrame:
    return postings.join(publishers.select("publisher"), "publisher", "left_semi")


def common_panel(postings: DataFrame) -> DataFrame:
    """Dense entity by shared publisher: postings, share of the entity's postings, share with items."""
    publishers = common_publishers(postings)
    size = postings.groupBy("entity").agg(F.count("*").alias("all"))
    cells = postings.groupBy("entity", "publisher").agg(F.count("*").alias("n"), F.avg(F.col("has_item").cast("double")).alias("item_coverage"))
    out = size.join(publishers, how="cross").join(cells, ["entity", "publisher"], "left")
    return out.select("entity", "publisher", F.coalesce("n", F.lit(0)).alias("postings"), (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share_of_entity"), "item_coverage")


def common_panel_by_period(postings: DataFrame, period: str = "month") -> DataFrame:
    """For every period the publishers that all entities share within it."""
    p = postings.withColumn("start", start_of(F.col("day"), period))
    every = _entities(postings).agg(F.count("*").alias("wanted"))
    cells = p.filter("publisher is not null").select("start", "publisher", "entity").distinct()
    shared = cells.groupBy("start", "publisher").agg(F.count("*").alias("carried")).join(F.broadcast(every), F.col("carried") == F.col("wanted"))
    listed = shared.groupBy("start").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("publisher")), ", ").alias("publishers"))
    present = p.groupBy("start").agg(F.countDistinct(F.when(F.col("publisher").isNotNull(), F.col("entity"))).alias("entities_present"))
    return present.join(listed, "start", "left").select(key_of(F.col("start"), period).alias("period"), F.coalesce("n", F.lit(0)).alias("n_common_publishers"), "entities_present", F.coalesce("publishers", F.lit("")).alias("publishers"))


def relative_share(postings: DataFrame) -> DataFrame:
    """Each entity's share of the common panel in both halves of the year, its change, and a smoothed log ratio; dense over entities."""
    half = half_of(F.col("day"))
    cut = restrict(postings, common_publishers(postings)).groupBy("entity").agg(F.count(F.when(half == "h1", 1)).alias("h1"), F.count(F.when(half == "h2", 1)).alias("h2"))
    out = _entities(postings).join(cut, "entity", "left").select("entity", F.coalesce("h1", F.lit(0)).alias("h1_postings"), F.coalesce("h2", F.lit(0)).alias("h2_postings"))
    totals = out.agg(F.sum("h1_postings").alias("t1"), F.sum("h2_postings").alias("t2"), F.count("*").alias("parts"))
    out = out.join(F.broadcast(totals))
    smooth = lambda k, t: (F.col(k) + 0.5) / (F.col(t) + 0.5 * F.col("parts"))
    out = out.withColumns({"h1_share": F.round(ratio(F.col("h1_postings"), F.col("t1")), 4), "h2_share": F.round(ratio(F.col("h2_postings"), F.col("t2")), 4)})
    return out.select("entity", "h1_postings", "h2_postings", "h1_share", "h2_share", F.round((F.col("h2_share") - F.col("h1_share")) * 100, 2).alias("share_change_pp"), F.round(F.ln(smooth("h2_postings", "t2") / smooth("h1_postings", "t1")), 3).alias("log_share_change"), F.col("t1").alias("panel_h1_total"), F.col("t2").alias("panel_h2_total"))


def relative_share_by_publisher(postings: DataFrame, min_half: int = 10) -> DataFrame:
    """The same inside every shared publisher whose halves both have at least min_half postings."""
    half = half_of(F.col("day"))
    publishers = common_publishers(postings)
    cells = restrict(postings, publishers).groupBy("publisher", "entity").agg(F.count(F.when(half == "h1", 1)).alias("h1"), F.count(F.when(half == "h2", 1)).alias("h2"))
    inside = Window.partitionBy("publisher")
    out = cells.withColumns({"t1": F.sum("h1").over(inside), "t2": F.sum("h2").over(inside), "parts": F.count("*").over(inside)}).filter((F.col("t1") >= min_half) & (F.col("t2") >= min_half))
    smooth = lambda k, t: (F.col(k) + 0.5) / (F.col(t) + 0.5 * F.col("parts"))
    return out.select("publisher", "entity", F.col("h1").alias("h1_postings"), F.col("h2").alias("h2_postings"), F.col("t1").alias("publisher_h1_total"), F.col("t2").alias("publisher_h2_total"), F.round(F.ln(smooth("h2", "t2") / smooth("h1", "t1")), 3).alias("log_share_change"))


def relative_share_verdict(by_publisher: DataFrame, pooled: DataFrame) -> DataFrame:
    """Does an entity's move have the pooled sign on every publisher, on most, or not?"""
    joined = by_publisher.join(pooled.select("entity", F.col("log_share_change").alias("pooled")), "entity")
    out = joined.groupBy("entity", "pooled").agg(F.count("*").alias("publishers_tested"), F.count(F.when(F.signum("log_share_change") == F.signum("pooled"), 1)).alias("publishers_agreeing"))
    agree, n = F.col("publishers_agreeing"), F.col("publishers_tested")
    return out.select("entity", F.col("pooled").alias("pooled_log_share_change"), "publishers_tested", "publishers_agreeing", F.when(agree == n, "confirmed").when(agree > n / 2, "mixed").otherwise("not supported").alias("verdict"), F.when(F.col("pooled") > 0, "gaining share").when(F.col("pooled") < 0, "losing share").otherwise("flat").alias("direction"))


def half_over_half(postings: DataFrame, min_share: float = 0.75) -> DataFrame:
    """Change of postings between halves on all and on panel publishers, and whether the signs agree."""
    half = half_of(F.col("day"))
    counts = lambda df, n: df.groupBy("entity").agg(F.count(F.when(half == "h1", 1)).alias(f"{n}_h1"), F.count(F.when(half == "h2", 1)).alias(f"{n}_h2"))
    out = counts(postings, "raw").join(counts(volume.on_panel(postings, "month", min_share), "balanced"), "entity", "left").na.fill(0, ["balanced_h1", "balanced_h2"])
    change = lambda n: (ratio(F.col(f"{n}_h2"), F.col(f"{n}_h1")) - 1) * 100
    out = out.withColumns({"raw_pct_change": change("raw"), "balanced_pct_change": change("balanced")})
    return out.withColumn("agrees", F.coalesce(F.signum("raw_pct_change") == F.signum("balanced_pct_change"), F.lit(False)))


def collection_artefacts(postings: DataFrame, period: str = "month") -> DataFrame:
    """For every period: is it thin for nearly all entities while publishers are fewer than usual?"""
    p = postings.withColumn("start", start_of(F.col("day"), period))
    starts, entities = p.select("start").distinct(), _entities(postings)
    cells = starts.join(entities, how="cross").join(p.groupBy("start", "entity").count(), ["start", "entity"], "left").withColumn("n", F.coalesce("count", F.lit(0)))
    medians = cells.groupBy("entity").agg(F.expr("percentile(n, 0.5)").alias("own_median"))
    per = cells.join(medians, "entity").groupBy("start").agg(F.sum("n").alias("postings"), F.count(F.when(F.col("n") < F.col("own_median"), 1)).alias("entities_below_own_median"), F.count("*").alias("n_entities"))
    out = per.join(p.groupBy("start").agg(F.countDistinct("publisher").alias("distinct_publishers")), "start")
    middle = out.agg(F.expr("percentile(distinct_publishers, 0.5)").alias("usual"))
    thin = (F.col("entities_below_own_median") >= F.col("n_entities") - 1) & (F.col("distinct_publishers") < F.col("usual"))
    return out.join(F.broadcast(middle)).select(key_of(F.col("start"), period).alias("period"), "postings", "distinct_publishers", "entities_below_own_median", "n_entities", ratio(F.col("postings"), F.col("distinct_publishers")).alias("postings_per_publisher"), thin.alias("shared_thin_month"))


def entity_correlation(postings: DataFrame, period: str = "month") -> DataFrame:
    """Pearson correlation of zero-filled period counts of every pair of entities."""
    p = postings.withColumn("start", start_of(F.col("day"), period))
    cells = p.select("start").distinct().join(_entities(postings), how="cross").join(p.groupBy("start", "entity").count(), ["start", "entity"], "left").select("start", "entity", F.coalesce("count", F.lit(0)).alias("n"))
    other = cells.withColumnsRenamed({"entity": "other", "n": "m"})
    return cells.join(other, "start").groupBy("entity", "other").agg(F.corr("n", "m").alias("r"))


def own_channels(postings: DataFrame, rules: DataFrame) -> DataFrame:
    """entity, publisher for every publisher that is the entity itself: the entity's own employer rule (rules as in text.classify_employers, key is the
    entity) matches the publisher's name. Distinct names are classified once each, however many postings they publish."""
    names = postings.groupBy(F.col("publisher").alias("name")).agg(F.count("*").alias("n"))
    own = text.classify_employers(names, rules).filter("matched").select(F.col("key").alias("entity"), F.col("name").alias("publisher")).distinct()
    return own.join(postings.select("entity", "publisher").distinct(), ["entity", "publisher"], "left_semi")


def own_channel_share(postings: DataFrame, own: DataFrame) -> DataFrame:
    """entity, own_channel_publishers, own_channel_postings, own_channel_share: what an entity publishes over channels of its own; an entity without one has zeros."""
    n = postings.groupBy("entity", "publisher").agg(F.count("*").alias("n"))
    flagged = n.join(own.select("entity", "publisher").distinct().withColumn("own", F.lit(1)), ["entity", "publisher"], "left")
    out = flagged.groupBy("entity").agg(F.count("own").alias("own_channel_publishers"), F.coalesce(F.sum(F.when(F.col("own") == 1, F.col("n"))), F.lit(0)).alias("own_channel_postings"), F.sum("n").alias("all"))
    return out.withColumn("own_channel_share", F.col("own_channel_postings") / F.col("all")).drop("all")


def comparability(postings: DataFrame, period: str = "month", min_share: float = 0.75, rules: DataFrame | None = None) -> DataFrame:
    """What may be compared of an entity: panel sizes and shares, trend verdict, item coverage; with rules of employers its own channels too."""
    panel, common = volume.panel_publishers(postings, period, min_share), common_publishers(postings)
    flagged = postings.join(panel.withColumn("_panel", F.lit(1)), ["entity", "publisher"], "left").join(common.withColumn("_common", F.lit(1)), "publisher", "left")
    low = F.coalesce(F.col("segment").isin(*EXCLUDED_SEGMENTS), F.lit(False))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    each = flagged.groupBy("entity").agg(
        F.count("*").alias("postings"), F.countDistinct("publisher").alias("publishers"), F.countDistinct(start_of(F.col("day"), period)).alias("months_observed"),
        F.countDistinct(F.when(F.col("_panel") == 1, F.col("publisher"))).alias("balanced_panel_publishers"), share(F.col("_panel") == 1).alias("balanced_panel_share"), share(F.col("_common") == 1).alias("common_panel_share"),
        share(F.col("has_item")).alias("item_coverage"), F.avg(F.when(~low, F.col("has_item").cast("double"))).alias("item_coverage_ex_excluded"), share(low).alias("excluded_share"),
    )
    top = postings.filter("publisher is not null").groupBy("entity", "publisher").agg(F.count("*").alias("n"))
    first = Window.partitionBy("entity").orderBy(F.desc("n"), "publisher")
    top = top.withColumns({"at": F.row_number().over(first), "all": F.sum("n").over(Window.partitionBy("entity"))}).filter("at = 1").select("entity", F.col("publisher").alias("top_publisher"), (F.col("n") / F.col("all")).alias("top_publisher_share"))
    verdict = volume.panel_verdict(volume.panel_sensitivity(postings, period, min_share)).select("entity", F.col("direction").alias("trend_direction"), "treatments_agree")
    if rules is not None:
        each = each.join(own_channel_share(postings, own_channels(postings, rules)), "entity")
    return each.join(top, "entity", "left").join(verdict, "entity", "left").withColumn("level_comparable", F.col("common_panel_share") >= MIN_COMMON_SHARE)


def level_verdict(gate: DataFrame, min_share: float = MIN_COMMON_SHARE) -> DataFrame:
    """Whether levels may be compared at all: every entity reaches the common panel with enough of its postings."""
    failing = F.array_join(F.sort_array(F.collect_list(F.when(F.col("common_panel_share") < min_share, F.col("entity")))), ", ")
    out = gate.agg(failing.alias("failing"))
    return out.select((F.col("failing") == "").alias("identified"), F.when(F.col("failing") == "", "all entities clear the common-panel floor").otherwise(F.concat(F.lit("common-panel coverage below the floor for "), "failing")).alias("reason"))


def mix(postings: DataFrame) -> DataFrame:
    """Share of each segment in an entity's postings with a score interval."""
    n = postings.withColumn("segment", F.coalesce("segment", F.lit("Unknown"))).groupBy("entity", "segment").agg(F.count("*").alias("postings"))
    n = n.withColumn("entity_postings", F.sum("postings").over(Window.partitionBy("entity")))
    lo, hi = wilson(F.col("postings"), F.col("entity_postings"))
    return n.withColumns({"share": F.col("postings") / F.col("entity_postings"), "ci_low": lo, "ci_high": hi})


def mix_distance(mixed: DataFrame) -> DataFrame:
    """Total-variation distance between the mixes of every pair of entities, zero-filled."""
    grid = mixed.select("entity").distinct().join(mixed.select("segment").distinct(), how="cross").join(mixed.select("entity", "segment", "share"), ["entity", "segment"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    other = grid.withColumnsRenamed({"entity": "other", "share": "p"})
    return grid.join(other, "segment").groupBy("entity", "other").agg((F.sum(F.abs(F.col("share") - F.col("p"))) / 2).alias("distance"))


def pooled_weights(postings: DataFrame) -> DataFrame:
    """segment, weight: the pooled mix of all entities."""
    n = postings.groupBy(F.coalesce("segment", F.lit("Unknown")).alias("segment")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("segment", (F.col("n") / F.col("all")).alias("weight"))


def standardise(hits: DataFrame, weights: DataFrame, by: list[str], min_cell: int = MIN_CELL) -> DataFrame:
    """hits: by, segment, hit (0 or 1). Crude rate and the rate under the weights' mix over strata with at least min_cell rows."""
    cells = hits.withColumn("segment", F.coalesce("segment", F.lit("Unknown"))).groupBy(*by, "segment").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    used = F.col("n") >= min_cell
    w = F.when(used, F.coalesce("weight", F.lit(0.0)))
    out = cells.join(weights, "segment", "left").groupBy(*by).agg((F.sum("k") / F.sum("n")).alias("crude"), F.sum(w * F.col("k") / F.col("n")).alias("_top"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight_covered"), F.count(F.when(used, 1)).alias("strata_used"))
    out = out.withColumn("standardised", ratio(F.col("_top"), F.col("weight_covered"))).drop("_top")
    return out.withColumn("mix_effect", F.col("crude") - F.col("standardised"))


def standardised_rate(postings: DataFrame, flag: str = "has_item", min_cell: int = MIN_CELL) -> DataFrame:
    return standardise(postings.select("entity", "segment", F.col(flag).cast("int").alias("hit")), pooled_weights(postings), ["entity"], min_cell)


def item_share(postings: DataFrame, items: DataFrame, min_postings: int = MIN_CELL) -> DataFrame:
    """For every entity and item: share of postings with items, with a score interval and a support flag."""
    base = denominator(postings)
    n = base.groupBy("entity").agg(F.count("*").alias("n_skilled"))
    k = of_base(items, base, "entity").groupBy("entity", "item", "item_group").agg(tally(items).alias("postings_with_item"))
    out = k.join(n, "entity")
    lo, hi = wilson(F.col("postings_with_item"), F.col("n_skilled"))
    return out.withColumns({"share_of_skilled": F.col("postings_with_item") / F.col("n_skilled"), "ci_low": lo, "ci_high": hi, "supported": F.col("postings_with_item") >= min_postings})


def _dense(share: DataFrame) -> DataFrame:
    """share filled with zeros for items that an entity lacks."""
    n = share.select("entity", "n_skilled").distinct()
    grid = n.join(share.select("item", "item_group").distinct(), how="cross")
    return grid.join(share.select("entity", "item", "postings_with_item"), ["entity", "item"], "left").withColumn("k", F.coalesce("postings_with_item", F.lit(0))).drop("postings_with_item")


def distinctiveness(share: DataFrame, vendors: DataFrame | None = None, min_postings: int = MIN_CELL, alpha: float = 0.05) -> DataFrame:
    """Every entity's item shares against the pooled rest: difference with interval, smoothed log lift, q-value over all items."""
    grid = _dense(share)
    everyone = share.select("entity", "n_skilled").distinct().agg(F.sum("n_skilled").alias("n_all"))
    grid = grid.withColumn("k_all", F.sum("k").over(Window.partitionBy("item"))).filter("k_all > 0").join(F.broadcast(everyone))
    k1, n1, k2, n2 = F.col("k"), F.col("n_skilled"), F.col("k_all") - F.col("k"), F.col("n_all") - F.col("n_skilled")
    lo, hi = newcombe(k1, n1, k2, n2)
    out = grid.select(
        "entity", "item", "item_group", F.col("k").alias("postings_with_item"), "n_skilled", k2.alias("rest_with_item"), n2.alias("rest_n_skilled"), (k1 / n1).alias("share"), ratio(k2, n2).alias("rest_share"),
        (k1 / n1 - ratio(k2, n2)).alias("diff"), lo.alias("diff_ci_low"), hi.alias("diff_ci_high"), F.log2(((k1 + 0.5) / (n1 + 1)) / ((k2 + 0.5) / (n2 + 1))).alias("log_lift"),
        two_proportion_p(k1, n1, k2, n2).alias("p_value"), ((k1 >= min_postings) | (k2 >= min_postings)).alias("supported"),
    )
    out = benjamini_hochberg(out, "p_value", ["entity"], ["item"])
    out = out.withColumn("significant", F.coalesce(F.col("q_value") <= alpha, F.lit(False)) & F.col("supported"))
    return out if vendors is None else annotate_self_reference(out, vendors)


def annotate_self_reference(table: DataFrame, vendors: DataFrame) -> DataFrame:
    """vendors: entity, item, relation. Flags an entity's own items; filters nothing."""
    out = table.join(vendors.withColumnRenamed("relation", "vendor_relation"), ["entity", "item"], "left").withColumn("vendor_relation", F.coalesce("vendor_relation", F.lit("")))
    return out.withColumn("self_referential", F.col("vendor_relation") != "")


def pairwise_gaps(share: DataFrame, min_postings: int = MIN_CELL, alpha: float = 0.05) -> DataFrame:
    """Item share gaps of every pair of entities; items rare on both sides leave before the q-values are taken."""
    grid = _dense(share)
    a = grid.select(F.col("entity").alias("entity_a"), "item", "item_group", F.col("k").alias("ka"), F.col("n_skilled").alias("na"))
    b = grid.select(F.col("entity").alias("entity_b"), "item", F.col("k").alias("kb"), F.col("n_skilled").alias("nb"))
    pair = a.join(b, "item").filter("entity_a < entity_b").filter(F.greatest("ka", "kb") >= min_postings)
    ka, na, kb, nb = (F.col(c) for c in ("ka", "na", "kb", "nb"))
    lo, hi = newcombe(ka, na, kb, nb)
    out = pair.withColumns({"a_share": ka / na, "b_share": kb / nb, "diff": ka / na - kb / nb, "ci_low": F.round(lo, 4), "ci_high": F.round(hi, 4), "p_value": two_proportion_p(ka, na, kb, nb)})
    out = benjamini_hochberg(out, "p_value", ["entity_a", "entity_b"], ["item"])
    return out.withColumn("significant", F.coalesce(F.col("q_value") <= alpha, F.lit(False)) & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)))


def self_reference(postings: DataFrame, long: DataFrame, vendors: DataFrame) -> DataFrame:
    """How much of an entity's item signal is its own items: shares with and without them, and the commonest of them."""
    own = long.join(vendors.filter("relation = 'own_product'").withColumn("own", F.lit(1)), ["entity", "item"], "left")
    per = own.groupBy("entity", "id").agg(F.count("own").alias("k_own"), F.count(F.when(F.col("own").isNull(), 1)).alias("k_other"))
    sums = per.groupBy("entity").agg(F.count(F.when(F.col("k_own") > 0, 1)).alias("with_own"), F.count(F.when(F.col("k_other") > 0, 1)).alias("with_other"), F.count(F.when((F.col("k_own") > 0) & (F.col("k_other") == 0), 1)).alias("only_own"))
    first = Window.partitionBy("entity").orderBy(F.desc("n"), "item")
    top = own.filter("own = 1").groupBy("entity", "item").agg(F.count("*").alias("n")).withColumn("at", F.row_number().over(first)).filter("at = 1").select("entity", F.col("item").alias("top_own_item"))
    out = postings.groupBy("entity").agg(F.count("*").alias("postings"), F.avg(F.col("has_item").cast("double")).alias("coverage")).join(sums, "entity", "left").join(top, "entity", "left").na.fill(0, ["with_own", "with_other", "only_own"])
    n = F.col("postings")
    return out.select("entity", "postings", F.col("with_own").alias("postings_with_own"), (F.col("with_own") / n).alias("own_share"), "coverage", (F.col("with_other") / n).alias("coverage_excl_own"), (100 * F.col("only_own") / n).alias("coverage_inflation_pp"), F.coalesce("top_own_item", F.lit("")).alias("top_own_item"))


def item_matrix(share: DataFrame, entities: list[str], min_entities: int = 2) -> DataFrame:
    """Items by entities, zero-filled, for items that at least min_entities have."""
    cells = share.groupBy("item").agg(*(F.coalesce(F.max(F.when(F.col("entity") == e, F.col("share_of_skilled"))), F.lit(0.0)).alias(e) for e in entities), F.countDistinct("entity").alias("present"))
    return cells.filter(F.col("present") >= min_entities).drop("present")


def _hits(postings: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Denominator postings by wanted items: entity, item, segment, cells of n rows and k hits."""
    base = denominator(postings).withColumn("segment", F.coalesce("segment", F.lit("Unknown")))
    n = base.groupBy("entity", "segment").agg(F.count("*").alias("n"))
    held = of_base(items, base, "entity", "segment").withColumn("segment", F.coalesce("segment", F.lit("Unknown")))
    k = held.groupBy("entity", "segment", "item").agg(tally(items).alias("k")).join(wanted, "item", "left_semi")
    return n.join(wanted, how="cross").join(k, ["entity", "segment", "item"], "left").withColumn("k", F.coalesce("k", F.lit(0)))


def top_items(share: DataFrame, top: int = 25) -> DataFrame:
    """The items with most supported postings over all entities."""
    return share.filter("supported").groupBy("item").agg(F.sum("postings_with_item").alias("n")).orderBy(F.desc("n"), "item").limit(top).select("item")


def supported_items(share: DataFrame) -> DataFrame:
    """Every item that some entity supports."""
    return share.filter("supported").select("item").distinct()


def standardised_items(postings: DataFrame, items: DataFrame, wanted: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """Crude and mix-standardised share of every wanted item for every entity; weights are the pooled mix of the denominator."""
    cells = _hits(postings, items, wanted).join(pooled_weights(denominator(postings)), "segment", "left")
    used = F.col("n") >= min_cell
    w = F.when(used, F.coalesce("weight", F.lit(0.0)))
    out = cells.groupBy("entity", "item").agg((F.sum("k") / F.sum("n")).alias("crude_share"), F.sum(w * F.col("k") / F.col("n")).alias("_top"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight_covered"), F.count(F.when(used, 1)).alias("strata_used"))
    out = out.withColumn("standardised_share", ratio(F.col("_top"), F.col("weight_covered"))).drop("_top")
    return out.withColumn("mix_effect", F.col("crude_share") - F.col("standardised_share"))


def within_stratum(postings: DataFrame, items: DataFrame, wanted: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """Share of every wanted item inside each segment with at least min_cell denominator postings."""
    cells = _hits(postings, items, wanted).filter(F.col("n") >= min_cell)
    lo, hi = wilson(F.col("k"), F.col("n"))
    return cells.select("entity", "item", "segment", F.col("k").alias("postings_with_item"), F.col("n").alias("n_skilled"), (F.col("k") / F.col("n")).alias("share"), lo.alias("ci_low"), hi.alias("ci_high"))


def stratified_entity_verdict(within: DataFrame, min_strata: int = 2) -> DataFrame:
    """For every item and pair: does the pooled sign of the gap hold in every shared stratum?"""
    w = within.withColumn("share4", F.round("share", 4))
    pooled = within.groupBy("entity", "item").agg((F.sum("postings_with_item") / F.greatest(F.sum("n_skilled"), F.lit(1))).alias("pooled"))
    a = w.select(F.col("entity").alias("entity_a"), "item", "segment", F.col("share4").alias("pa"))
    b = w.select(F.col("entity").alias("entity_b"), "item", "segment", F.col("share4").alias("pb"))
    pa, pb = (pooled.select(F.col("entity").alias(f"entity_{x}"), "item", F.col("pooled").alias(f"pooled_{x}")) for x in "ab")
    both = a.join(b, ["item", "segment"]).filter("entity_a < entity_b").join(pa, ["entity_a", "item"]).join(pb, ["entity_b", "item"])
    sign = F.signum(F.col("pooled_a") - F.col("pooled_b"))
    out = both.groupBy("item", "entity_a", "entity_b", (F.col("pooled_a") - F.col("pooled_b")).alias("pooled_diff")).agg(F.count("*").alias("n_strata"), F.count(F.when(F.signum(F.col("pa") - F.col("pb")) == sign, 1)).alias("agree"))
    enough, agree, n = F.col("n_strata") >= min_strata, F.col("agree"), F.col("n_strata")
    return out.select("item", "entity_a", "entity_b", F.when(enough, F.col("pooled_diff")).alias("pooled_diff"), n, F.when(enough, agree).otherwise(0).alias("n_agree"), F.when(~enough, "unsupported").when(agree == n, "confirmed").when(agree == 0, "reversed").otherwise("mixed").alias("verdict"))


def panel_robustness(postings: DataFrame, items: DataFrame, min_postings: int = MIN_CELL) -> DataFrame:
    """Item shares on all and on common publishers; an item absent from the panel is a measured zero there."""
    cut = restrict(postings, common_publishers(postings))
    every = item_share(postings, items, min_postings).select("entity", "item", "item_group", F.col("postings_with_item").alias("k_all"), F.col("n_skilled").alias("n_all"))
    panel = item_share(cut, items, min_postings).select("entity", "item", F.col("postings_with_item").alias("k_panel"))
    n = denominator(cut).groupBy("entity").agg(F.count("*").alias("n_panel"))
    out = every.join(panel, ["entity", "item"], "left").join(n, "entity", "left").withColumns({"n_panel": F.coalesce("n_panel", F.lit(0)), "k_panel": F.coalesce("k_panel", F.when(F.col("n_panel") > 0, 0))})
    out = out.withColumns({"share_all": F.col("k_all") / F.col("n_all"), "share_panel": ratio(F.col("k_panel"), F.col("n_panel"))})
    delta = F.col("share_panel") - F.col("share_all")
    return out.withColumns({"share_delta": delta, "channel_sensitive": F.coalesce(F.abs(delta) > 0.10, F.lit(False))})


def feasibility_screen(postings: DataFrame, min_postings: int = 250, min_months: int = 10) -> DataFrame:
    """Which entities have enough postings over enough months to be compared, and why the others have not."""
    g = postings.groupBy("entity").agg(F.count("*").alias("postings"), F.countDistinct(F.trunc("day", "MM")).alias("months"), F.countDistinct("publisher").alias("publishers"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    few, short = F.col("postings") < min_postings, F.col("months") < min_months
    reasons = F.concat_ws("; ", F.when(few, F.format_string("%d postings (need %d)", "postings", F.lit(min_postings))), F.when(short, F.format_string("%d months (need %d)", "months", F.lit(min_months))))
    return g.withColumns({"verdict": F.when(few | short, "excluded").otherwise("included"), "reason": reasons})


def half_without(postings: DataFrame, starts: DataFrame) -> DataFrame:
    """Panel shares of both halves with and without given months (start), and whether the change keeps its sign."""
    every = relative_share(postings).select("entity", F.col("log_share_change").alias("with_all"))
    kept = postings.withColumn("start", start_of(F.col("day"), "month")).join(starts, "start", "left_anti").drop("start")
    less = relative_share(kept).select("entity", F.col("log_share_change").alias("without"))
    return every.join(less, "entity").withColumn("sign_unchanged", F.signum("with_all") == F.signum("without"))


def significant_gaps_checked(gaps: DataFrame, stratified: DataFrame, most: int = 40) -> DataFrame:
    """The widest significant gaps of every pair (a top-k report) with their verdict inside strata; gaps that strata don't cover are unsupported."""
    at = F.row_number().over(Window.partitionBy("entity_a", "entity_b").orderBy(F.desc(F.abs("diff")), "item"))
    lead = gaps.filter("significant").withColumn("at", at).filter(F.col("at") <= most)
    found = stratified.select("item", "entity_a", "entity_b", "n_strata", "n_agree", "verdict")
    return lead.join(found, ["item", "entity_a", "entity_b"], "left").select("entity_a", "entity_b", "item", "at", "diff", F.coalesce("n_strata", F.lit(0)).alias("n_strata"), F.coalesce("n_agree", F.lit(0)).alias("n_agree"), F.coalesce("verdict", F.lit("unsupported")).alias("verdict"))
