"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions of the bindings in roles.py.
POSTINGS = """
postings_all AS (
  SELECT o_orderkey AS id, c_mktsegment AS entity, n_name AS publisher, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS segment,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS value, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_item
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
postings AS (SELECT * FROM postings_all)"""
PRICES = """
postings AS (
  SELECT o_orderkey AS id, CASE WHEN o_totalprice / (1 + 0.06::DOUBLE * (year(o_orderdate) - 1995)) < 100000 THEN 'modest' WHEN o_totalprice / (1 + 0.06::DOUBLE * (year(o_orderdate) - 1995)) < 300000 THEN 'middling' ELSE 'large' END AS entity,
         n_name AS publisher, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
ITEMS = """
items AS (SELECT DISTINCT l_orderkey AS id, p_name AS item, split_part(p_name, ' ', 2) AS item_group FROM lineitem JOIN part ON l_partkey = p_partkey),
long AS (SELECT i.id, i.item, i.item_group, p.entity, p.publisher, p.segment, p.day FROM items i JOIN postings p ON i.id = p.id)"""
EVENTS = """
postings AS (
  SELECT event_id AS id, event_type AS entity, CAST(user_id AS VARCHAR) AS publisher, CAST(ts AS DATE) AS day,
         CASE WHEN value >= 10 THEN 'high' ELSE 'low' END AS segment, value, value > 5 AS has_item FROM events)"""
ELIGIBLE = "eligible AS (SELECT * FROM postings WHERE coalesce(segment NOT IN ('5-LOW'), TRUE)), base AS (SELECT * FROM eligible WHERE has_item)"
COMMON = """
common AS (SELECT publisher FROM postings WHERE publisher IS NOT NULL GROUP BY publisher
           HAVING count(DISTINCT entity) = (SELECT count(DISTINCT entity) FROM postings))"""


def stated(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles to six digits, so that engines that add in another order state the same."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under name; sql is DuckDB's statement of its rows."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: stated(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
