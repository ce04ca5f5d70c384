"""Required literals of patterns, employer rules met through them, linkage and nulls against plain renderings."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmeter.operators import mentions, similarity, text


@pytest.mark.parametrize(
    "pattern,want",
    [
        (r"\bgoogle\b", ("google",)), (r"\b(google|deepmind)\b", ("deepmind", "google")), (r"meta(?: platforms)?$", ("meta",)), (r"(abc)?d", ("d",)), (r"[ab]+", ()), (r"a|[b]", ()),
        (r"x{0,2}yz", ("yz",)), (r"(?:nv)+idia", ("idia",)), (r"^Micro\s*soft", ("micro",)), (r"(?=look)ahead", ("ahead",)), (r"\p{Lu}x", ()), ("", ()),
    ],
)
def test_required_literals(pattern, want):
    assert mentions.required(pattern) == want


def test_literals_stand_in_every_match():
    rng = random.Random(2)
    parts = ["ab", "(?:cd|ef)", "g?", "[hi]", "(jk)+", r"\s", "(?:lm)?", "n{2}", "|", "op*"]
    for _ in range(500):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        held = mentions.required(pattern)
        for _ in range(30):
            t = "".join(rng.choice(["ab", "cd", "ef", "g", "h", "jk", "lm", "nn", "o", "p", " "]) for _ in range(8))
            if held and re.search(pattern, t):
                assert any(x in t for x in held), (pattern, t)


def test_rules_meet_names_as_a_theta_join_does(spark):
    rng = random.Random(7)
    words = ["Google", "google llc", "Deep Mind", "Meta", "metal works", "Microsoft", "staffing", "Red, Engineer", "Oracle", "", "x9"]
    names = spark.createDataFrame([(" ".join(rng.sample(words, 3)), k) for k in range(150)] + [(None, 1), ("  ", 2)], "name string, n int").dropDuplicates(["name"])
    rules = spark.createDataFrame([("g", r"\bgoogle\b|deep\s*mind", r"\bmetal\b", [("Mind", "mind")]), ("m", r"\bmeta", None, []), ("g", "microsoft", "", []), ("any", r"[0-9]", "", [])], "key string, include string, exclude string, brands array<struct<brand: string, pattern: string>>")
    got = text.classify_employers(names, rules)
    assert "BroadcastNestedLoopJoin" not in text.classify_employers(names, rules.filter("key <> 'any'"))._jdf.queryExecution().executedPlan().toString()
    want = sorted((r.key, n.name) for n in names.collect() for r in rules.collect() if (n.name or "").strip() and re.search(r.include, re.sub(r"\s+", " ", n.name).strip(), re.I))
    assert sorted((r.key, r.name) for r in got.collect()) == want


def plain_linkage(names, distance):
    live, merges = {(n,): [i] for i, n in enumerate(names)}, []
    while len(live) > 1:
        gap, a, b = min((float(distance[np.ix_(live[x], live[y])].mean()), x, y) for x, y in itertools.combinations(sorted(live), 2))
        merges.append((a, b, gap))
        live[tuple(sorted(a + b))] = live.pop(a) + live.pop(b)
    return merges


def test_linkage_merges_as_all_means_do():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 12, 25):
        for ties in (False, True):
            names = [f"e{k:02d}" for k in rng.permutation(n)]
            d = rng.integers(1, 4, (n, n)) / 4 if ties else rng.random((n, n))
            d = np.triu(d, 1) + np.triu(d, 1).T
            got, want = similarity.average_linkage(names, d), plain_linkage(names, d)
            assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])


def test_linkage_of_many_entities():
    d = np.random.default_rng(1).random((1000, 1000))
    d = np.triu(d, 1) + np.triu(d, 1).T
    merges = similarity.average_linkage([f"e{k:04d}" for k in range(1000)], d)
    gaps = [m[2] for m in merges]
    assert len(merges) == 999 and all(a <= b + 1e-12 for a, b in zip(gaps, gaps[1:]))


@pytest.fixture(scope="module")
def profile(spark):
    rng = random.Random(5)
    rows = [(e, f"i{k:02d}", rng.randrange(0, n // 2), n) for e, n in (("a", 400), ("b", 150), ("c", 60)) for k in range(40)]
    return spark.createDataFrame(rows, "entity string, item string, k long, n long").withColumn("share", F.col("k") / F.col("n")).cache()


def test_nulls_meet_theory(spark, profile):
    """A permutation keeps an entity's counts and puts each at every place alike; binomial counts have their mean and spread."""
    n = 400
    dealt = similarity.null_counts(profile, "unrelated", n).cache()
    for e in "abc":
        own = sorted(r.k for r in profile.filter((F.col("entity") == e) & (F.col("k") > 0)).collect())
        draws = {r.draw: sorted(r.ks) for r in dealt.filter(F.col("entity") == e).groupBy("draw").agg(F.collect_list("k").alias("ks")).collect()}
        assert len(draws) == n and all(d == own for d in draws.values())
    mean = profile.filter("entity = 'a'").agg(F.avg("k")).first()[0]
    sd = profile.filter("entity = 'a'").agg(F.stddev_pop("k")).first()[0]
    for r in dealt.filter("entity = 'a'").groupBy("item").agg((F.sum("k") / n).alias("m")).collect():
        assert abs(r.m - mean) < 5 * sd / n**0.5
    drawn = similarity.null_counts(profile, "identical", n)
    p = {r.item: r.share for r in similarity.pooled_profile(profile).collect()}
    for r in drawn.filter("entity = 'b'").groupBy("item").agg((F.sum("k") / n).alias("m"), F.sum(F.col("k") * F.col("k")).alias("q")).collect():
        want, spread = 150 * p[r.item], (150 * p[r.item] * (1 - p[r.item])) ** 0.5
        assert abs(r.m - want) < 5 * spread / n**0.5 and abs((r.q / n - r.m**2) ** 0.5 - spread) < 0.3 * spread + 0.1


def test_nulls_do_not_depend_on_tasks(profile):
    for kind in ("identical", "unrelated"):
        one = {tuple(r) for r in similarity.null_counts(profile, kind, 20).collect()}
        other = {tuple(r) for r in similarity.null_counts(profile.repartition(7, "item"), kind, 20).collect()}
        assert one == other


def test_cosines_of_counts(spark):
    rows = [(0, "a", "x", 3), (0, "a", "y", 4), (0, "b", "x", 6), (0, "b", "y", 8), (0, "c", "z", 1), (1, "a", "x", 1)]
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    got = {(r.draw, r.entity_a, r.entity_b): r.value for r in similarity.resampled_cosines(spark.createDataFrame(rows, "draw int, entity string, item string, k long"), entities, 2).collect()}
    assert got[0, "a", "b"] == pytest.approx(1) and got[0, "a", "c"] == 0 and got[1, "a", "b"] is None and len(got) == 6
