"""Similarity of entities' item profiles: metrics, sensitivities, resampling, clustering, co-movement of shares.

Profiles are long: entity, item, share; pairs are entities a < b. Postings are reduced to counts before any pair is formed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions.stats import average_rank, correlation, fisher_interval, ratio
from postmeter.operators.items import denominator, of_base, tally
from postmeter.sources.tables import settled

METRICS = ("cosine", "jensen_shannon", "bray_curtis", "spearman")
FAMILIES = {"cosine": "prevalence_weighted", "jensen_shannon": "prevalence_weighted", "bray_curtis": "prevalence_weighted", "spearman": "rank", "jaccard_supported": "set"}
MIN_CELL, STABILITY_FLOOR, SEED, MIN_PERIODS = 10, 0.90, 20260818, 8
#: Dispersion of a closure null where a series has too few periods for one of its own.
DEFAULT_SIGMA = 0.3
#: Sums for entity and item, each over all draws, that a task holds before it sends them.
HELD_CELLS = 20_000
#: Rows of a profile whose draws are held at once.
DRAWN_ROWS = 500


def profiles(postings: DataFrame, items: DataFrame) -> DataFrame:
    """entity, item, k, n, share over the vocabulary of all entities; all denominator postings count."""
    base = denominator(postings)
    return _profile(base, of_base(items, base, "entity").groupBy("entity", "item").agg(tally(items).alias("k")))


def _profile(base: DataFrame, k: DataFrame) -> DataFrame:
    """The profile of denominator postings with the counts k: entity, item, k."""
    n = base.groupBy("entity").agg(F.count("*").alias("n"))
    grid = n.join(k.select("item").distinct(), how="cross").join(k, ["entity", "item"], "left")
    return grid.select("entity", "item", F.coalesce("k", F.lit(0)).alias("k"), "n", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("share"))


def pooled_profile(profile: DataFrame) -> DataFrame:
    total = profile.select("entity", "n").distinct().agg(F.sum("n").alias("all"))
    return profile.groupBy("item").agg(F.sum("k").alias("k")).join(F.broadcast(total)).select("item", (F.col("k") / F.col("all")).alias("share"))


def supported_sets(profile: DataFrame, min_postings: int = MIN_CELL) -> DataFrame:
    return profile.filter(F.col("k") >= min_postings).groupBy("entity").agg(F.count("*").alias("supported"))


def paired(profile: DataFrame) -> DataFrame:
    """entity_a < entity_b, item, pa, pb, ka, kb and average ranks ra, rb within each entity."""
    ranked = profile.withColumn("r", average_rank(F.col("share"), ["entity"])).withColumn("total", F.sum("share").over(Window.partitionBy("entity")))
    a = ranked.select(F.col("entity").alias("entity_a"), "item", F.col("share").alias("pa"), F.col("k").alias("ka"), F.col("r").alias("ra"), F.col("total").alias("ta"))
    b = ranked.select(F.col("entity").alias("entity_b"), "item", F.col("share").alias("pb"), F.col("k").alias("kb"), F.col("r").alias("rb"), F.col("total").alias("tb"))
    return a.join(b, "item").filter("entity_a < entity_b")


def _kl(p: Column, m: Column) -> Column:
    return F.sum(F.when(p > 0, p * F.log2(p / m)).otherwise(0.0))


def metric_columns(keep: Column | None = None) -> dict[str, Column]:
    """Each metric as an aggregate over paired items, optionally over the kept ones only."""
    on = (lambda c: c) if keep is None else (lambda c: F.when(keep, c))
    pa, pb = on(F.col("pa")), on(F.col("pb"))
    na, nb = ratio(F.col("pa"), F.col("ta")), ratio(F.col("pb"), F.col("tb"))
    m = (na + nb) / 2
    dot, qa, qb = F.sum(pa * pb), F.sum(pa * pa), F.sum(pb * pb)
    return {
        "cosine": F.when((qa > 0) & (qb > 0), dot / F.sqrt(qa * qb)),
        "jensen_shannon": F.when((F.max("ta") > 0) & (F.max("tb") > 0), 1 - F.sqrt(F.greatest((_kl(na, m) + _kl(nb, m)) / 2, F.lit(0.0)))),
        "bray_curtis": 1 - ratio(F.sum(F.abs(pa - pb)), F.sum(pa + pb)),
        "spearman": correlation(on(F.col("ra")), on(F.col("rb"))),
    }


def _rank(c: str) -> Column:
    return F.rank().over(Window.orderBy(F.round(F.col(c), 4).desc_nulls_last()))


def pair_table(profile: DataFrame, min_postings: int = MIN_CELL) -> DataFrame:
    """Every metric of every pair, its rank, and how far the ranks are apart. A pair a row: few rows, so ranks are global."""
    supported = {s: F.col(s) >= min_postings for s in ("ka", "kb")}
    both = F.count(F.when(supported["ka"] & supported["kb"], 1))
    either = F.count(F.when(supported["ka"] | supported["kb"], 1))
    out = paired(profile).groupBy("entity_a", "entity_b").agg(*(c.alias(n) for n, c in metric_columns().items()), ratio(both, either).alias("jaccard_supported"))
    names = [*METRICS, "jaccard_supported"]
    out = out.withColumns({f"rank_{m}": _rank(m) for m in names})
    ranks = [F.col(f"rank_{m}") for m in names]
    return out.withColumn("rank_spread", F.greatest(*ranks) - F.least(*ranks))


def similarity_matrix(profile: DataFrame, metric: str = "cosine") -> DataFrame:
    """Long square matrix with ones on the diagonal."""
    p = paired(profile).groupBy("entity_a", "entity_b").agg(metric_columns()[metric].alias("similarity"))
    mirrored = p.select(F.col("entity_b").alias("entity_a"), F.col("entity_a").alias("entity_b"), "similarity")
    own = profile.select(F.col("entity").alias("entity_a"), F.col("entity").alias("entity_b")).distinct().withColumn("similarity", F.lit(1.0))
    return p.unionByName(mirrored).unionByName(own)


def concordance(pairs: DataFrame) -> DataFrame:
    """Rank correlation between every two metrics over the pairs, and whether they are of one family."""
    names = [*METRICS, "jaccard_supported"]
    ranked = pairs.withColumns({f"r_{m}": average_rank(F.col(f"rank_{m}"), []) for m in names})
    combos = list(itertools.combinations(names, 2))
    row = ranked.agg(*(correlation(F.col(f"r_{a}"), F.col(f"r_{b}")).alias(f"{a}|{b}") for a, b in combos))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.lit(FAMILIES[a] == FAMILIES[b]).alias("same_family"), F.col(f"`{a}|{b}`").alias("rank_correlation")) for a, b in combos)))
    return row.select(each.alias("x")).select("x.*")


def vendor_sensitivity(profile: DataFrame, vendors: DataFrame) -> DataFrame:
    """Cosine of every pair with all items, without the pair's own items, and without anyone's own items; rank moves."""
    mine = vendors.select("entity", "item").distinct()
    p = paired(profile)
    p = p.join(mine.select(F.col("entity").alias("entity_a"), "item", F.lit(1).alias("va")), ["entity_a", "item"], "left")
    p = p.join(mine.select(F.col("entity").alias("entity_b"), "item", F.lit(1).alias("vb")), ["entity_b", "item"], "left")
    p = p.join(mine.select("item", F.lit(1).alias("vx")).distinct(), "item", "left")
    cos = lambda keep: metric_columns(keep)["cosine"]
    out = p.groupBy("entity_a", "entity_b").agg(cos(None).alias("all_items"), cos(F.col("va").isNull() & F.col("vb").isNull()).alias("pair_items_dropped"), cos(F.col("vx").isNull()).alias("all_own_dropped"))
    out = out.withColumns({f"rank_{c}": _rank(c) for c in ("all_items", "pair_items_dropped", "all_own_dropped")})
    return out.withColumn("rank_move", F.col("rank_all_own_dropped") - F.col("rank_all_items"))


def support_sensitivity(profile: DataFrame, min_postings: int = MIN_CELL) -> DataFrame:
    """Cosine on all items against those that every entity supports."""
    wide = profile.withColumn("core", F.min("k").over(Window.partitionBy("item")) >= min_postings)
    core = wide.filter("core").select("item").distinct().withColumn("is_core", F.lit(True))
    p = paired(profile).join(core, "item", "left")
    cos = lambda keep: metric_columns(keep)["cosine"]
    out = p.groupBy("entity_a", "entity_b").agg(cos(None).alias("all_items"), cos(F.col("is_core")).alias("core_items"), F.count("*").alias("n_all"), F.count("is_core").alias("n_core"))
    out = out.withColumns({"rank_all": _rank("all_items"), "rank_core": _rank("core_items")})
    return out.withColumn("rank_move", F.col("rank_core") - F.col("rank_all"))


def group_removal(profile: DataFrame, group: Column) -> DataFrame:
    """Cosine of every pair before and after items leave for which group (over item) holds."""
    cos = lambda keep: metric_columns(keep)["cosine"]
    out = paired(profile).groupBy("entity_a", "entity_b").agg(cos(None).alias("with_group"), cos(~group).alias("without_group"))
    return out.withColumns({"delta": F.col("without_group") - F.col("with_group"), "rank_with": _rank("with_group"), "rank_without": _rank("without_group")})


def numerator_contribution(profile: DataFrame, groups: dict[str, Column], top: int = 5) -> DataFrame:
    """Share of the cosine's numerator that named groups of items and the leading items carry."""
    p = paired(profile).withColumn("prod", F.col("pa") * F.col("pb"))
    first = Window.partitionBy("entity_a", "entity_b").orderBy(F.desc("prod"), "item")
    p = p.withColumn("at", F.row_number().over(first))
    total = F.sum("prod")
    parts = [x for n, g in groups.items() for x in (ratio(F.sum(F.when(g, F.col("prod")).otherwise(0.0)), total).alias(f"share_{n}"), F.count(F.when(g, 1)).alias(f"n_{n}"))]
    leading = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("at") <= top, F.struct("at", "item")))), lambda x: x["item"]), ", ")
    return p.groupBy("entity_a", "entity_b").agg(total.alias("numerator"), *parts, ratio(F.sum(F.when(F.col("at") <= top, F.col("prod"))), total).alias(f"share_top{top}"), leading.alias(f"top{top}_items"))


def mix_sensitivity(standardised: DataFrame) -> DataFrame:
    """Cosine on crude and on mix-standardised item shares (entity, item, crude_share, standardised_share, weight_covered)."""
    s = standardised.na.fill(0.0, ["crude_share", "standardised_share"])
    a = s.select(F.col("entity").alias("entity_a"), "item", F.col("crude_share").alias("ca"), F.col("standardised_share").alias("sa"), F.col("weight_covered").alias("wa"))
    b = s.select(F.col("entity").alias("entity_b"), "item", F.col("crude_share").alias("cb"), F.col("standardised_share").alias("sb"), F.col("weight_covered").alias("wb"))
    cos = lambda x, y: ratio(F.sum(F.col(x) * F.col(y)), F.sqrt(F.sum(F.col(x) * F.col(x)) * F.sum(F.col(y) * F.col(y))))
    out = a.join(b, "item").filter("entity_a < entity_b").groupBy("entity_a", "entity_b").agg(cos("ca", "cb").alias("crude"), cos("sa", "sb").alias("standardised"), F.count("*").alias("items_used"), F.least(F.min("wa"), F.min("wb")).alias("weight_covered_min"))
    out = out.withColumns({"mix_effect": F.col("crude") - F.col("standardised"), "rank_crude": _rank("crude"), "rank_standardised": _rank("standardised")})
    return out.withColumn("rank_move", F.col("rank_standardised") - F.col("rank_crude"))


def draws(spark, n: int, make, schema: str, seed: int = SEED, tasks: int = 8) -> DataFrame:
    """n simulated draws spread over tasks; make(rng, draw) yields rows. Each draw has a generator of its own, so any order of tasks gives the same rows."""

    def run(batches):
        for pdf in batches:
            rows = [r for d in pdf["id"] for r in make(np.random.default_rng([seed, int(d)]), int(d))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return spark.range(0, n, 1, tasks).mapInPandas(run, schema)


def null_counts(profile: DataFrame, kind: str, n: int = 300) -> DataFrame:
    """draw, entity, item, k under a null: identical (postings drawn from the pooled profile) or unrelated (an entity's counts permuted over items).

    Every number is named by its draw, entity and item: a permutation is a rank over keyed hashes, and binomial counts come from a
    counter-based generator keyed by entity and item. So no draw is one group, and neither tasks nor the order of rows change a value."""
    if kind == "unrelated":
        place = Window.partitionBy("entity").orderBy("item")
        held = profile.select("entity", "item", "k", F.row_number().over(place).alias("at"))
        keyed = held.select("entity", "item", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
        ticket = F.xxhash64(F.lit(SEED), "draw", "entity", "item")
        dealt = keyed.withColumn("at", F.row_number().over(Window.partitionBy("draw", "entity").orderBy(ticket, "item")))
        return dealt.join(held.select("entity", "at", "k"), ["entity", "at"]).filter("k > 0").select("draw", "entity", "item", "k")
    pooled = pooled_profile(profile).withColumnRenamed("share", "p")
    rows = profile.join(pooled, "item").filter("p > 0").select("entity", "item", F.col("n").cast("long").alias("n"), F.least("p", F.lit(1.0)).alias("p"), F.xxhash64("entity", "item").alias("key"))

    def draw(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), DRAWN_ROWS):
                some = pdf.iloc[lo : lo + DRAWN_ROWS]
                k = np.stack([np.random.Generator(np.random.Philox(key=[SEED + 1, int(key) & 0xFFFFFFFFFFFFFFFF])).binomial(size, p, n) for size, p, key in zip(some["n"], some["p"], some["key"])])
                at, draw_ = np.nonzero(k)
                yield pd.DataFrame({"draw": draw_.astype(np.int32), "entity": some["entity"].to_numpy()[at], "item": some["item"].to_numpy()[at], "k": k[at, draw_]})

    return rows.mapInPandas(draw, "draw int, entity string, item string, k long")


def null_draws(profile: DataFrame, kind: str, n: int = 300) -> DataFrame:
    """draw, entity_a, entity_b, value: cosines of every pair under a null; null where an entity drew nothing."""
    return resampled_cosines(null_counts(profile, kind, n), profile, n)


def calibration(profile: DataFrame, n: int = 300) -> DataFrame:
    """Observed cosine between both nulls: 0 is no shared structure, 1 the same entity twice."""
    observed = paired(profile).groupBy("entity_a", "entity_b").agg(metric_columns()["cosine"].alias("observed"))
    side = lambda kind, q, name: null_draws(profile, kind, n).groupBy("entity_a", "entity_b").agg(F.avg("value").alias(name), F.expr(f"percentile(value, {q})").alias(f"{name}_bound"))
    out = observed.join(side("identical", 0.025, "identical"), ["entity_a", "entity_b"]).join(side("unrelated", 0.975, "unrelated"), ["entity_a", "entity_b"])
    return out.withColumns({"calibrated": ratio(F.col("observed") - F.col("unrelated"), F.col("identical") - F.col("unrelated")), "distinct": F.col("observed") < F.col("identical_bound"), "above_unrelated": F.col("observed") > F.col("unrelated_bound")})


def posting_patterns(postings: DataFrame, items: DataFrame) -> DataFrame:
    """entity, pattern (sorted items), n: postings that carry the same items are one weighted row for resampling."""
    base = denominator(postings)
    per = items.join(base.select("id", "entity"), "id").groupBy("entity", "id").agg(F.sort_array(F.collect_set("item")).alias("pattern"))
    return per.groupBy("entity", "pattern").agg(F.count("*").alias("n"))


def pattern_profile(postings: DataFrame, patterns: DataFrame) -> DataFrame:
    """profiles() of the postings whose patterns these are: an item's postings are those of the patterns that hold it, so items are not joined again."""
    each = patterns.select("entity", F.explode("pattern").alias("item"), "n")
    return _profile(denominator(postings), each.groupBy("entity", "item").agg(F.sum("n").alias("k")))


def resampled(patterns: DataFrame, n: int = 600, seed: int = SEED) -> DataFrame:
    """draw, entity, item, k: item counts when whole postings are redrawn with replacement within their entity.

    Each pattern's postings get a Poisson weight a draw, the limit of redrawing many postings, from a generator of the pattern's own, so
    how rows are dealt over tasks changes nothing. Items of a posting stay together. Tasks send sums for entity, item and draw only.
    """
    keyed = patterns.select("entity", "pattern", F.col("n").cast("long").alias("n"), F.xxhash64("entity", "pattern").alias("key"))

    def draw(batches):
        held: dict[tuple[str, str], np.ndarray] = {}

        def rows():
            for (entity, item), k in held.items():
                some = np.flatnonzero(k)
                yield pd.DataFrame({"draw": some.astype(np.int32), "entity": entity, "item": item, "k": k[some]})

        for pdf in batches:
            for entity, pattern, count, key in pdf.itertuples(index=False):
                weight = np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF]).poisson(count, n)
                for item in pattern:
                    if (entity, item) in held:
                        held[entity, item] += weight
                    else:
                        held[entity, item] = weight.astype(np.int64)
            if len(held) > HELD_CELLS:
                yield from rows()
                held.clear()
        yield from rows()

    return keyed.mapInPandas(draw, "draw int, entity string, item string, k long").groupBy("draw", "entity", "item").agg(F.sum("k").alias("k"))


def resampled_cosines(counts: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    """draw, entity_a, entity_b, value for every pair and draw; shares and counts have the same cosine."""
    norms = counts.groupBy("draw", "entity").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("q"))
    # An item's row holds the entities that have it, its pairs are products of that row, and only their sums are shuffled.
    held = counts.groupBy("draw", "item").agg(F.sort_array(F.collect_list(F.struct("entity", F.col("k").cast("double").alias("k")))).alias("held"))
    later = lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x["entity"].alias("entity_a"), y["entity"].alias("entity_b"), (x["k"] * y["k"]).alias("dot")))
    dots = held.select("draw", F.explode(F.flatten(F.transform("held", later))).alias("p")).groupBy("draw", "p.entity_a", "p.entity_b").agg(F.sum("p.dot").alias("dot"))
    names = entities.select("entity").distinct()
    pairs = names.select(F.col("entity").alias("entity_a")).join(names.select(F.col("entity").alias("entity_b")), F.col("entity_a") < F.col("entity_b"))
    grid = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    side = lambda s: norms.select("draw", F.col("entity").alias(f"entity_{s}"), F.col("q").alias(f"q{s}"))
    out = grid.join(dots, ["draw", "entity_a", "entity_b"], "left").join(side("a"), ["draw", "entity_a"], "left").join(side("b"), ["draw", "entity_b"], "left")
    return out.select("draw", "entity_a", "entity_b", ratio(F.coalesce("dot", F.lit(0.0)), F.sqrt(F.col("qa") * F.col("qb"))).alias("value"))


def bootstrap(postings: DataFrame, items: DataFrame, n: int = 600) -> DataFrame:
    """Interval and rank stability of every pair's cosine when whole postings are redrawn. Patterns and drawn sums are read by several branches, so each is written once."""
    patterns = settled(posting_patterns(postings, items))
    profile = settled(pattern_profile(postings, patterns))
    observed = paired(profile).groupBy("entity_a", "entity_b").agg(metric_columns()["cosine"].alias("observed"))
    observed = observed.withColumn("rank", F.rank().over(Window.orderBy(F.col("observed").desc_nulls_last())))
    drawn = resampled_cosines(settled(resampled(patterns, n)), profile, n)
    drawn = drawn.withColumn("drawn_rank", F.rank().over(Window.partitionBy("draw").orderBy(F.col("value").desc_nulls_last())))
    q = lambda c, p: F.expr(f"percentile({c}, {p})")
    out = drawn.join(observed, ["entity_a", "entity_b"]).groupBy("entity_a", "entity_b", "observed", "rank").agg(
        q("value", 0.025).alias("ci_low"),
        q("value", 0.975).alias("ci_high"),
        q("drawn_rank", 0.025).cast("int").alias("rank_low"),
        q("drawn_rank", 0.975).cast("int").alias("rank_high"),
        F.avg((F.col("drawn_rank") == F.col("rank")).cast("double")).alias("rank_stability"),
        F.count("*").alias("draws"),
    )
    return out.withColumn("rank_identified", F.col("rank_stability") >= STABILITY_FLOOR)


def rank_tiers(boot: DataFrame) -> DataFrame:
    """Pairs whose rank intervals overlap share a tier: islands in order of rank (a pair a row)."""
    before = Window.orderBy("rank", "entity_a", "entity_b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("rank", "entity_a", "entity_b").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("rank_low") > F.max("rank_high").over(before), 1).otherwise(0)
    return boot.withColumn("_opens", opens).withColumn("tier", F.sum("_opens").over(upto) + 1).drop("_opens")


def average_linkage(names: list[str], distance: np.ndarray) -> list[tuple[tuple[str, ...], tuple[str, ...], float]]:
    """Average-linkage merges of entities, the least mean distance first; ties go by the members' names.

    Sums of members' distances are updated by each merge, and every cluster remembers its nearest later one, so a merge looks at one row and
    at those that lost their neighbour. A cluster stands at the place of its first name: places in order are clusters in order of names."""
    order = np.argsort(np.array(names, object), kind="stable")
    members = [(names[k],) for k in order]
    n = len(names)
    total = np.array(distance, float)[np.ix_(order, order)]
    size, live = np.ones(n), np.ones(n, bool)
    nearest, gap = np.full(n, -1), np.full(n, np.inf)

    def look(i: int) -> None:
        row = np.where(live[i + 1 :], total[i, i + 1 :] / (size[i] * size[i + 1 :]), np.inf)
        nearest[i], gap[i] = (-1, np.inf) if not len(row) or np.isinf(row.min()) else (i + 1 + int(row.argmin()), row.min())

    for i in range(n):
        look(i)
    merges = []
    for _ in range(n - 1):
        i = int(gap.argmin())
        j = int(nearest[i])
        merges.append((members[i], members[j], float(gap[i])))
        members[i] = tuple(sorted(members[i] + members[j]))
        total[i, :] += total[j, :]
        total[:, i] = total[i, :]
        size[i] += size[j]
        live[j], gap[j] = False, np.inf
        look(i)
        before = np.flatnonzero(live[:i])
        to = total[before, i] / (size[before] * size[i])
        lost = (nearest[before] == i) | (nearest[before] == j)
        closer = ~lost & ((to < gap[before]) | ((to == gap[before]) & (i < nearest[before])))
        nearest[before[closer]], gap[before[closer]] = i, to[closer]
        for k in before[lost].tolist() + [k for k in range(i + 1, j) if live[k] and nearest[k] == j]:
            look(k)
    return merges


def cut(names: list[str], merges, k: int) -> str:
    parts = {(n,) for n in names}
    for a, b, _ in merges:
        if len(parts) <= k:
            break
        parts = (parts - {a, b}) | {tuple(sorted(a + b))}
    return " | ".join(sorted(",".join(p) for p in parts))


def cluster_support(postings: DataFrame, items: DataFrame, cuts=(2, 3, 4), n: int = 600) -> DataFrame:
    """How often redrawn postings give the observed partition at each cut. For support without some items, hand in items without them."""
    entities = settled(postings.select("entity").distinct())
    patterns = settled(posting_patterns(postings, items))
    observed = pattern_profile(postings, patterns).select(F.lit(-1).alias("draw"), "entity", "item", "k")
    counts = settled(observed.filter("k > 0").unionByName(resampled(patterns, n)))
    grid = resampled_cosines(counts.withColumn("draw", F.col("draw") + 1), entities, n + 1)

    def partitions(key, t: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*t["entity_a"], *t["entity_b"]})
        d = np.zeros((len(names), len(names)))
        at = {x: k for k, x in enumerate(names)}
        for a, b, v in zip(t["entity_a"], t["entity_b"], t["value"]):
            d[at[a], at[b]] = d[at[b], at[a]] = 1 - (0.0 if pd.isna(v) else v)
        m = average_linkage(names, d)
        return pd.DataFrame([(int(key[0]), c, cut(names, m, c)) for c in cuts], columns=["draw", "clusters", "partition"])

    found = grid.groupBy("draw").applyInPandas(partitions, "draw int, clusters int, partition string")
    own = found.filter("draw = 0").select("clusters", F.col("partition").alias("observed"))
    same = found.filter("draw > 0").join(F.broadcast(own), "clusters").withColumn("same", (F.col("partition") == F.col("observed")).cast("double"))
    return same.groupBy("clusters", F.col("observed").alias("partition")).agg(F.avg("same").alias("support"), F.count("*").alias("draws"))


def network_thresholds(pairs: DataFrame, entities: DataFrame, grid=tuple(round(0.40 + 0.05 * k, 2) for k in range(13)), value: str = "cosine") -> DataFrame:
    """Edges, components and isolated entities as the threshold rises. Least labels spread along edges until none moves."""
    t = F.explode(F.array(*(F.lit(float(g)) for g in grid))).alias("threshold")
    edges = pairs.select("entity_a", "entity_b", value, t).filter(F.round(value, 4) >= F.col("threshold"))
    both = settled(edges.select("threshold", F.col("entity_a").alias("x"), F.col("entity_b").alias("y")).union(edges.select("threshold", "entity_b", "entity_a")))
    label = settled(entities.select(F.col("entity").alias("x"), t).withColumn("l", F.col("x")))
    changed = True
    while changed:  # each round is written, so neither lineage nor cached tables pile up
        near = both.join(label.select("threshold", F.col("x").alias("y"), F.col("l").alias("m")), ["threshold", "y"]).groupBy("threshold", "x").agg(F.min("m").alias("m"))
        moved = settled(label.join(near, ["threshold", "x"], "left").select("threshold", "x", F.least("l", F.coalesce("m", "l")).alias("l"), (F.col("m") < F.col("l")).alias("moved")))
        changed = not moved.filter("moved").isEmpty()
        label = moved.drop("moved")
    degree = both.groupBy("threshold", "x").agg(F.count("*").alias("d"))
    per = label.join(degree, ["threshold", "x"], "left")
    out = per.groupBy("threshold").agg(F.coalesce((F.sum("d") / 2).cast("long"), F.lit(0)).alias("edges"), F.countDistinct("l").alias("components"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("d").isNull(), F.col("x")))), ",").alias("isolated"), F.count(F.when(F.col("d").isNull(), 1)).alias("n_isolated"))
    return out


def panel_wide(series: DataFrame) -> DataFrame:
    """key, start, l (log share), c (centred log share) over the periods in which every key has a share."""
    keys = series.select("key").distinct().agg(F.count("*").alias("wanted"))
    common = series.filter("is_observed and share > 0").groupBy("start").agg(F.count("*").alias("c")).join(F.broadcast(keys), F.col("c") == F.col("wanted")).select("start")
    s = series.join(common, "start", "left_semi").withColumn("l", F.ln("share"))
    return s.select("key", "start", "l", (F.col("l") - F.avg("l").over(Window.partitionBy("start"))).alias("c"))


def calibrated_sigma(series: DataFrame) -> DataFrame:
    """n_periods, n_parts, sigma: the dispersion at which independent series are as volatile as these.

    Closing a composition leaves its centred logs as they were, so those of independent lognormal parts spread by sigma times the root of
    (parts - 1) / parts; sigma is the observed spread divided by that."""
    t = panel_wide(series).agg(F.countDistinct("start").alias("n_periods"), F.countDistinct("key").alias("n_parts"), F.stddev_samp("c").alias("spread"))
    return t.select("n_periods", "n_parts", (F.col("spread") * F.sqrt(ratio(F.col("n_parts"), F.col("n_parts") - 1))).alias("sigma"))


def trajectories(series: DataFrame, gate: DataFrame, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Co-movement of panel shares over the periods that all keys observed: log and centred-log correlations, variation, eligibility."""
    s = panel_wide(series)
    passed = gate.select("key", (F.col("verdict") == "forecastable").alias("g"))
    s = s.join(passed, "key")
    a = s.select(F.col("key").alias("entity_a"), "start", F.col("l").alias("la"), F.col("c").alias("ca"), F.col("g").alias("gate_a"))
    b = s.select(F.col("key").alias("entity_b"), "start", F.col("l").alias("lb"), F.col("c").alias("cb"), F.col("g").alias("gate_b"))
    out = a.join(b, "start").filter("entity_a < entity_b").groupBy("entity_a", "entity_b", "gate_a", "gate_b").agg(F.count("*").alias("n_periods"), correlation(F.col("la"), F.col("lb")).alias("r_log_share"), correlation(F.col("ca"), F.col("cb")).alias("r_clr"), F.var_samp(F.col("la") - F.col("lb")).alias("aitchison_variation"))
    lo, hi = fisher_interval(F.col("r_log_share"), F.col("n_periods"))
    out = out.withColumns({"ci_low": lo, "ci_high": hi}).withColumn("ci_width", F.col("ci_high") - F.col("ci_low"))
    return out.withColumns({"eligible": F.col("gate_a") & F.col("gate_b") & (F.col("n_periods") >= min_periods), "excludes_zero": F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))})


def closure_expectation(parts: int) -> float | None:
    """The mean correlation that closure alone forces on a composition."""
    return -1.0 / (parts - 1) if parts > 1 else None


def closure_null(spark, periods: int, parts: int, sigmas=(DEFAULT_SIGMA,), n: int = 300) -> DataFrame:
    """Mean pairwise log correlation of independent lognormal series closed by their sum: its centre and band for each sigma."""

    def make(rng, d):
        z = rng.normal(0.0, 1.0, (periods, parts))
        for sigma in sigmas:
            x = np.exp(sigma * z)
            c = np.corrcoef(np.log(x / x.sum(axis=1, keepdims=True)), rowvar=False)
            yield d, float(sigma), float(c[np.triu_indices(parts, 1)].mean())

    q = lambda p: F.expr(f"percentile(value, {p})")
    return draws(spark, n, make, "draw int, sigma double, value double").groupBy("sigma").agg(F.avg("value").alias("mean"), q(0.025).alias("p2_5"), q(0.975).alias("p97_5")).withColumn("analytic", F.lit(closure_expectation(parts)))


def closure_sensitivity(mean_r: float, null: DataFrame) -> DataFrame:
    """For each dispersion of a closure null: whether an observed mean correlation is inside its band, and else on which side."""
    r = F.lit(mean_r)
    inside = r.between(F.col("p2_5"), F.col("p97_5"))
    side = F.when(inside, "").when(r < F.col("p2_5"), "below").otherwise("above")
    return null.withColumns({"band_width": F.col("p97_5") - F.col("p2_5"), "gap_to_analytic": F.col("mean") - F.col("analytic"), "observed_mean_r": r, "inside": inside, "side_if_outside": side})


def trajectory_verdict(table: DataFrame, null: DataFrame) -> DataFrame:
    """Whether co-movement is identified: enough eligible pairs, a mean outside the closure band, intervals that are not too wide."""
    t = table.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("eligible"), 1)).alias("eligible_pairs"), F.avg("r_log_share").alias("mean_r"), F.avg("ci_width").alias("mean_width"))
    out = t.join(F.broadcast(null.select("p2_5", "p97_5").limit(1)))
    reasons = F.array_compact(F.array(
        F.when(F.col("eligible_pairs") < F.col("pairs"), F.format_string("only %d of %d pairs pass the gate", "eligible_pairs", "pairs")),
        F.when(F.col("mean_r").between(F.col("p2_5"), F.col("p97_5")), F.lit("mean correlation is inside the closure band")),
        F.when(F.col("mean_width") > 1, F.lit("intervals span too much of the range")),
    ))
    return out.select("pairs", "eligible_pairs", "mean_r", "mean_width", (F.size(reasons) == 0).alias("identified"), F.array_join(reasons, "; ").alias("reason"))


def pair_verdicts(boot: DataFrame, pairs: DataFrame, vendor: DataFrame, mixed: DataFrame) -> DataFrame:
    """unresolved, vendor_dependent, metric_dependent, mix_dependent or robust: the first check that a pair's rank fails."""
    family = [F.col(f"rank_{m}") for m, f in FAMILIES.items() if f == "prevalence_weighted"]
    p = pairs.select("entity_a", "entity_b", (F.greatest(*family) - F.least(*family)).alias("family_spread"))
    on = ["entity_a", "entity_b"]
    out = boot.select(*on, "rank", "rank_stability", "rank_identified").join(p, on).join(vendor.select(*on, F.abs("rank_move").alias("vendor_move")), on, "left").join(mixed.select(*on, F.abs("rank_move").alias("mix_move")), on, "left").na.fill(0, ["vendor_move", "mix_move"])
    verdict = F.when(~F.col("rank_identified"), "unresolved").when(F.col("vendor_move") > 1, "vendor_dependent").when(F.col("family_spread") > 1, "metric_dependent").when(F.col("mix_move") > 1, "mix_dependent").otherwise("robust")
    return out.withColumn("verdict", verdict)
