"""Order statistics without gathering a cell."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postmeter.operators import selection


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [("hot", rng.choice([1.5, 1.5, 1.5, rng.random()])) for _ in range(3000)]
    out += [(c, float(rng.randrange(n))) for c, n in (("a", 1), ("b", 2), ("c", 3), ("d", 50), (None, 7)) for _ in range(n)]
    return [*out, ("a", None), ("nothing", None)]


def cells_of(rows):
    cells = defaultdict(list)
    for c, v in rows:
        if v is not None:
            cells[c].append(v)
    return {c: sorted(v) for c, v in cells.items()}


def test_medians(spark, rows):
    df = spark.createDataFrame(rows, "c string, value double").repartition(4)
    got = {r.c: (r.n, r.m) for r in selection.medians(df, ["c"]).collect()}
    assert got == {c: (len(v), statistics.median(v)) for c, v in cells_of(rows).items()}
    assert selection.medians(df.limit(0), ["c"]).count() == 0


def test_values_at_places(spark, rows):
    cells = {c: v for c, v in cells_of(rows).items() if c is not None}
    df = spark.createDataFrame(rows, "c string, value double")
    held = selection.runs(df, ["c"]).cache()
    wanted = [(c, k) for c, v in cells.items() for k in {0, len(v) // 3, len(v) // 2, len(v) - 1, len(v) + 5}]
    got = {(r.c, r.k): r.value for r in selection.values_at(held, spark.createDataFrame(wanted * 2, "c string, k long"), ["c"]).collect()}
    assert got == {(c, k): cells[c][k] for c, k in wanted if k < len(cells[c])}


def test_no_task_holds_a_large_cell(spark):
    """One cell of 200,000 values over 16 ranges: none holds a quarter of it."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(200_000).select(F.lit("x").alias("c"), (F.xxhash64("id") / 1e12).alias("value"))
        held = selection.runs(df, ["c"]).cache()
        assert held.groupBy("part").count().agg(F.max("count")).first()[0] < 50_000 and held.count() == 200_000
        m = selection.medians(df, ["c"]).first()
        assert m.n == 200_000 and m.m == pytest.approx(df.selectExpr("percentile(value, 0.5)").first()[0], rel=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
