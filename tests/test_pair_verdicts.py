"""Verdicts of pairs rest on every item that some entity supports, not on the leading ones."""

import datetime
import math

import duckdb
import pytest

from postmeter.operators import compare, similarity
from postmeter.plans import all_queries

QUERIES, SQL = all_queries()


def test_verdicts_see_every_supported_item(spark, small):
    """Mix-standardised ranks against SQL's, without its bound on items: with 25 of the 50 items other pairs move."""
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    whole = con.execute(f"select entity_a, entity_b, items_used, abs(rank_move) from ({SQL['similarity_mix_sensitivity'].replace(' LIMIT 25', '')})").fetchall()
    assert {r[2] for r in whole} == {50}
    got = {(r.entity_a, r.entity_b): r.mix_move for r in QUERIES["similarity_pair_verdicts"](spark, small).collect()}
    assert got == {(a, b): move for a, b, _, move in whole}


@pytest.fixture(scope="module")
def many(spark):
    """Forty items that entities ask for oftener the later their number, one that a single entity supports, one that none does; segments differ between entities."""
    day = datetime.date(1995, 1, 1)
    p = [(k, "abc"[k % 3], "x", day, ("1-URGENT", "2-HIGH", None)[(k // 3 * (1 + k % 3) + k // 7) % 3], True, None) for k in range(600)]
    held = [(k, f"item {j:02d}", "group") for k, *_ in p for j in range(40) if (k * (j + 3) + j * (k % 3)) % 40 <= 4 + j // 2]
    held += [(3 * k, "once", "group") for k in range(10)] + [(k, "rare", "group") for k in range(27)]
    return p, held, spark.createDataFrame(p, "id long, entity string, publisher string, day date, segment string, has_item boolean, value double"), spark.createDataFrame(held, "id long, item string, item_group string")


def test_mix_of_all_supported_items(many):
    p, held, postings, items = many
    wanted = compare.supported_items(compare.item_share(postings, items))
    names = sorted(r.item for r in wanted.collect())
    assert names == sorted([f"item {j:02d}" for j in range(40)] + ["once"])
    segment = {k: s or "Unknown" for k, _, _, _, s, *_ in p}
    size = {e: {s: [k for k, x, *_ in p if x == e and segment[k] == s] for s in set(segment.values())} for e in "abc"}
    weight = {s: sum(len(size[e][s]) for e in "abc") / len(p) for s in set(segment.values())}
    has = {n: {k for k, i, _ in held if i == n} for n in names}
    crude = {e: [sum(k in has[n] for at in size[e].values() for k in at) / 200 for n in names] for e in "abc"}
    mixed = {e: [sum(weight[s] * sum(k in has[n] for k in at) / len(at) for s, at in size[e].items()) for n in names] for e in "abc"}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    got = similarity.mix_sensitivity(compare.standardised_items(postings, items, wanted)).collect()
    assert len(got) == 3 and all(r.items_used == 41 for r in got)
    for r in got:
        assert r.crude == pytest.approx(cos(crude[r.entity_a], crude[r.entity_b])) and r.standardised == pytest.approx(cos(mixed[r.entity_a], mixed[r.entity_b]))
        assert abs(r.mix_effect) > 1e-6
