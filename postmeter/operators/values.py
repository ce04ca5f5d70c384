"""Disclosed values of postings: who discloses, where pairs can be compared, and paired medians with resampled intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions.stats import ratio, sign_test_p
from postmeter.operators import selection
from postmeter.sources.tables import settled

MIN_CELL, FLOORS = 5, (0, 3, 5, 10)


def disclosure(postings: DataFrame) -> DataFrame:
    """Share of postings with a value, publishers with any, and the commonest segment among all and among disclosed postings."""
    g = postings.groupBy("entity").agg(F.count("*").alias("postings"), F.count("value").alias("disclosed"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("publisher"))).alias("publishers_disclosing"))

    def modal(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy("entity", "segment").agg(F.count("*").alias("n"))
        n = n.withColumns({"at": F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "segment")), "all": F.sum("n").over(Window.partitionBy("entity"))})
        return n.filter("at = 1").select("entity", F.col("segment").alias(f"modal_{name}"), (F.col("n") / F.col("all")).alias(f"modal_share_{name}"))

    out = g.join(modal(postings, "all"), "entity", "left").join(modal(postings.filter("value is not null"), "disclosed"), "entity", "left")
    return out.withColumns({"disclosed_share": ratio(F.col("disclosed"), F.col("postings")), "shift_pp": 100 * (F.col("modal_share_disclosed") - F.col("modal_share_all"))})


def disclosure_by_publisher(postings: DataFrame) -> DataFrame:
    return postings.groupBy("publisher").agg(F.count("*").alias("postings"), F.count("value").alias("disclosed")).withColumn("disclosed_share", ratio(F.col("disclosed"), F.col("postings")))


def feasible_cells(postings: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """For every publisher the entities with enough disclosed values, and how many pairs that makes."""
    cells = postings.filter("value is not null").groupBy("publisher", "entity").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cell)
    g = cells.groupBy("publisher").agg(F.count("*").alias("entities"), F.array_join(F.sort_array(F.collect_list("entity")), ", ").alias("names"))
    return g.withColumn("pairs", (F.col("entities") * (F.col("entities") - 1) / 2).cast("long"))


def pair_medians(postings: DataFrame, by: tuple[str, ...] = ("publisher",), min_cell: int = MIN_CELL) -> DataFrame:
    """Difference of exact medians of every pair of entities inside each publisher (and segment) where both have enough values."""
    cells = selection.medians(postings, [*by, "entity"]).filter(F.col("n") >= min_cell)
    a = cells.withColumnsRenamed({"entity": "entity_a", "n": "n_a", "m": "median_a"})
    b = cells.withColumnsRenamed({"entity": "entity_b", "n": "n_b", "m": "median_b"})
    return a.join(b, list(by)).filter("entity_a < entity_b").withColumn("difference", F.col("median_a") - F.col("median_b"))


def _redrawn_medians(postings: DataFrame, by: list[str], n_boot: int, seed: int) -> DataFrame:
    """*by, entity, draw, m: medians of redrawn values of every cell.

    The median of a redrawing stands at one or two places of the sorted values, and which ones follows from Beta variates alone. So tasks
    draw places, from a generator of the cell's own, and a join fetches the values that stand there: no cell is gathered."""
    cell = [*by, "entity"]
    held = settled(selection.runs(postings.filter(" and ".join(f"{c} is not null" for c in cell)), cell))
    sizes = held.select(*cell, "n").distinct()
    keyed = sizes.withColumn("key", F.xxhash64(*cell))

    def draw(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n, rng = int(row["n"]), np.random.default_rng([seed, row["key"] & 0xFFFFFFFFFFFFFFFF])
                low = (n + 1) // 2
                u = rng.beta(low, n - low + 1, n_boot)
                v = u if n % 2 else u + (1 - u) * rng.beta(1, n - low, n_boot)
                at = lambda x: np.minimum((x * n).astype(np.int64), n - 1)  # noqa: E731, B023
                yield pd.DataFrame({**{c: row[c] for c in cell}, "draw": np.arange(n_boot), "k1": at(u), "k2": at(v)})

    kinds = ", ".join(f"{c} {sizes.schema[c].dataType.simpleString()}" for c in cell)
    places = settled(keyed.mapInPandas(draw, f"{kinds}, draw int, k1 long, k2 long"))
    found = selection.values_at(held, places.select(*cell, F.explode(F.array("k1", "k2")).alias("k")), cell)
    one = places.select(*cell, "draw", F.explode(F.array("k1", "k2")).alias("k")).join(found, [*cell, "k"])
    return one.groupBy(*cell, "draw").agg(F.avg("value").alias("m"))


def pair_intervals(postings: DataFrame, pairs: DataFrame, n_boot: int = 2000, seed: int = 20240609, by: tuple[str, ...] = ("publisher",)) -> DataFrame:
    """Resampled 95 % interval of each median difference; pairs: *by, entity_a, entity_b, difference."""
    drawn = _redrawn_medians(postings, list(by), n_boot, seed)
    a = drawn.select(*by, "draw", F.col("entity").alias("entity_a"), F.col("m").alias("ma"))
    b = drawn.select(*by, "draw", F.col("entity").alias("entity_b"), F.col("m").alias("mb"))
    both = pairs.select(*by, "entity_a", "entity_b", "difference").join(a, [*by, "entity_a"]).join(b, [*by, "draw", "entity_b"])
    q = lambda p: F.expr(f"percentile(ma - mb, {p})")
    return both.groupBy(*by, "entity_a", "entity_b", "difference").agg(q(0.025).alias("ci_low"), q(0.975).alias("ci_high"))


def stratified_pairs(postings: DataFrame, min_cell: int = MIN_CELL, n_boot: int = 2000) -> DataFrame:
    """Pairs inside each publisher and segment: difference, interval and verdict; a cell below the floor on either side is untestable."""
    by = ("publisher", "segment")
    every = pair_medians(postings, by, 1).select(*by, "entity_a", "entity_b", "n_a", "n_b", "difference")
    band = pair_intervals(postings, every.filter((F.col("n_a") >= min_cell) & (F.col("n_b") >= min_cell)), n_boot, by=by).drop("difference")
    out = every.join(band, [*by, "entity_a", "entity_b"], "left")
    tested, apart = F.col("ci_low").isNotNull(), (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    out = out.withColumn("verdict", F.when(~tested, "untestable").when(apart, "difference").otherwise("no difference identified"))
    return out.withColumn("identified", F.col("verdict") == "difference")


def value_verdict(disclosed: DataFrame, feasible: DataFrame, pairs: DataFrame, stratified: DataFrame) -> DataFrame:
    """A row an entity: what could be compared, what was identified, and the refusal that follows from who discloses."""
    two = feasible.agg(F.count(F.when(F.col("entities") >= 2, 1)).alias("publishers_with_two"))
    sides = lambda t, *cols: t.select(F.explode(F.array("entity_a", "entity_b")).alias("entity"), *cols)
    p = sides(pairs, "ci_low", "ci_high").groupBy("entity").agg(F.count("*").alias("pairs"), F.count(F.when((F.col("ci_low") > 0) | (F.col("ci_high") < 0), 1)).alias("pairs_excluding_zero"))
    s = sides(stratified, "verdict").filter("verdict <> 'untestable'").groupBy("entity").agg(F.count("*").alias("cells_tested"), F.count(F.when(F.col("verdict") == "difference", 1)).alias("cells_identified"))
    out = disclosed.select("entity", "disclosed_share", "shift_pp").join(F.broadcast(two)).join(p, "entity", "left").join(s, "entity", "left")
    out = out.na.fill(0, ["pairs", "pairs_excluding_zero", "cells_tested", "cells_identified"])
    return out.withColumns({"benchmark_available": F.lit(False), "verdict": F.lit("refused: disclosure belongs to publishers, so a level by entity is conditional on publisher, place and role")})


def cell_floors(by_publisher: DataFrame, pooled: DataFrame, floors=FLOORS) -> DataFrame:
    """Publishers that agree with the pooled sign, recounted at several smallest cells, with the exact sign-test p."""
    grid = F.explode(F.array(*map(F.lit, floors))).alias("floor")
    joined = by_publisher.join(pooled.select("entity", F.col("log_share_change").alias("pooled")), "entity").select("*", grid)
    kept = joined.withColumn("use", F.least("h1_postings", "h2_postings") >= F.col("floor"))
    out = kept.groupBy("entity", "floor").agg(F.count(F.when(F.col("use"), 1)).alias("tested"), F.count(F.when(F.col("use") & (F.signum("log_share_change") == F.signum("pooled")), 1)).alias("agreeing"))
    return out.withColumns({"confirmed": (F.col("tested") > 0) & (F.col("tested") == F.col("agreeing")), "p_value": sign_test_p(F.col("agreeing"), F.col("tested"))})


def floor_dependence(recount: DataFrame) -> DataFrame:
    """Whether an entity's confirmation comes and goes with the floor, and whether it is gained by dropping tests."""
    g = recount.groupBy("entity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("confirmed"), F.col("floor")))), lambda x: x.cast("string")), ", ").alias("floors_confirmed"), F.count("*").alias("floors_tested"), F.count(F.when(F.col("confirmed"), 1)).alias("c"), F.min_by("tested", "floor").alias("first_tested"), F.max_by("tested", "floor").alias("last_tested"), F.min_by("confirmed", "floor").alias("first_confirmed"))
    dependent = (F.col("c") > 0) & (F.col("c") < F.col("floors_tested"))
    return g.select("entity", "floors_confirmed", "floors_tested", dependent.alias("floor_dependent"), (dependent & ~F.col("first_confirmed") & (F.col("last_tested") < F.col("first_tested"))).alias("gained_by_dropping_tests"))


def sign_test_power(spark, most: int = 8) -> DataFrame:
    """p of a unanimous sign test at n publishers."""
    return spark.range(1, most + 1).select(F.col("id").alias("n"), sign_test_p(F.col("id"), F.col("id")).alias("p_value"))
