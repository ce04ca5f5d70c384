"""Binding of physical tables to the roles that every operator works on.

postings: id, entity, publisher, day, segment, has_item, value, one row for each posting.
items: id, item, item_group, one row for each posting and item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments whose postings carry no items by nature and are left out of item denominators.
EXCLUDED_SEGMENTS = ("5-LOW",)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings: market segment is the entity, nation the publisher, priority the segment."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    skilled = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("has_item", F.lit(True))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("entity"),
        F.col("n_name").alias("publisher"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").alias("segment"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("value"),
    ).join(skilled, "id", "left").withColumn("has_item", F.coalesce("has_item", F.lit(False)))


#: What prices gain a year, and the bounds of the classes in prices of the first year.
DEFLATOR, FIRST_YEAR, CLASS_BOUNDS = 0.06, 1995, ((100_000, "modest"), (300_000, "middling"))


def price_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings whose entity is the class of the order's price in the first year's prices: its shares move over the years."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    real = F.col("o_totalprice") / (1 + DEFLATOR * (F.year("o_orderdate") - FIRST_YEAR))
    kind = F.lit("large")
    for most, name in reversed(CLASS_BOUNDS):
        kind = F.when(real < most, name).otherwise(kind)
    return joined.select(F.col("o_orderkey").alias("id"), kind.alias("entity"), F.col("n_name").alias("publisher"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("segment"), F.lit(True).alias("has_item"), F.col("o_totalprice").alias("value"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names of each order; the noun of a name is the item's group."""
    part = read(spark, sf_dir, "part")
    lines = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").alias("id"), F.col("p_name").alias("item"), F.split("p_name", " ")[1].alias("item_group")).distinct()


#: Bounds of an order's size in distinct items.
SIZE_BOUNDS = ((3, "few items"), (5, "some items"))


def size_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings whose entity is the order's size in distinct items: larger orders hold any item oftener, so shares of items differ."""
    sizes = order_items(spark, sf_dir).groupBy("id").agg(F.count("*").alias("k"))
    kind = F.lit("many items")
    for most, name in reversed(SIZE_BOUNDS):
        kind = F.when(F.coalesce("k", F.lit(0)) < most, name).otherwise(kind)
    return order_postings(spark, sf_dir).join(sizes, "id", "left").withColumn("entity", kind).drop("k")


def event_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings: type is the entity, user the publisher."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("entity"),
        F.col("user_id").cast("string").alias("publisher"),
        F.col("ts").cast("date").alias("day"),
        F.when(F.col("value") >= 10, "high").otherwise("low").alias("segment"),
        F.col("value").alias("value"),
        (F.col("value") > 5).alias("has_item"),
    )


#: How a posting's raw texts are made of an order's columns: by priority, market segment, status, and remainders of keys.
LEVELS = {"1-URGENT": "Senior Staff ", "2-HIGH": "Sr. ", "3-MEDIUM": "", "4-NOT SPECIFIED": "Junior ", "5-LOW": "Intern, "}
ROLES = {"AUTOMOBILE": "Data Center Technician", "BUILDING": "Product Manager", "FURNITURE": "data analyst", "HOUSEHOLD": "Software Engineer, Google Cloud", "MACHINERY": "Machine Learning Scientist"}
ENDINGS = {"F": " II", "O": ", Summer 1997", "P": " ..."}
EMPLOYERS = ("Google {}", "Waymo", "Premier Partner {} Google", "Engineer, Google {}", "Red Bolt {}", "Old Gear Staffing")
PLACES = ("{}, {}", "Sunnyvale, CA", "Anywhere", "City - {} (+2 others)", "Riyadh Saudi Arabia", "")


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a raw posting: job_title, company_name, location, posting_date, job_description, extracted_skills,
    skill_categories and employment_type, made of the order's, customer's, nation's and parts' columns."""
    orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    # One shuffle by order: a set of names needs no distinct before it, and groups are read from the names.
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    named = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("p_name")).alias("names"))
    named = named.withColumn("groups", F.sort_array(F.array_compact(F.array_distinct(F.transform("names", lambda n: F.split(n, " ")[1])))))
    pick = lambda m, c: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[c]
    nth = lambda forms, c, *args: F.element_at(F.array(*(F.format_string(f.replace("{}", "%s"), *args[: f.count("{}")]) for f in forms)), (c % len(forms) + 1).cast("int"))
    key = F.col("o_orderkey")
    raw = joined.select(
        key.alias("id"),
        F.concat(pick(LEVELS, F.col("o_orderpriority")), pick(ROLES, F.col("c_mktsegment")), pick(ENDINGS, F.col("o_orderstatus"))).alias("job_title"),
        nth(EMPLOYERS, F.col("c_custkey"), F.col("n_name")).alias("company_name"),
        nth(PLACES, key, F.col("n_name"), F.col("r_name")).alias("location"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("posting_date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Internship").otherwise("Full-time").alias("employment_type"),
    )
    quoted = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda w: F.concat(F.lit("'"), F.upper(w), F.lit("'"))), ", "), F.lit("]"))
    return raw.join(named, "id", "left").select(
        *raw.columns,
        F.concat(F.lit("<p>Experience with "), F.array_join("names", ", "), F.lit("</p><br>&amp; more&nbsp;work.")).alias("job_description"),
        quoted(F.col("groups")).alias("extracted_skills"),
        F.concat(F.lit("{'parts': "), quoted(F.col("groups")), F.lit("}")).alias("skill_categories"),
    )
