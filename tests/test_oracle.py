"""Every query with SQL holds against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from postmeter.plans import all_queries

QUERIES, SQL = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x.isoformat()[:10] if hasattr(x, "isoformat") else x


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in records), key=str)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, small, name):
    got = QUERIES[name](spark, small)
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert len(a) == len(b)
    assert all(same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))
