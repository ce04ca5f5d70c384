"""The company set: only what changed is written, reruns leave everything as it is."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postmeter.operators import text
from postmeter.operators.skills import Skill
from postmeter.sources import company_set

TAXONOMY = [Skill("Python", "Programming Language"), Skill("SQL", "Programming Language")]
RULES = [("acme", r"\bacme\b", "", [("Acme Labs", "labs"), ("Acme", "acme")]), ("bolt", r"\bbolt\b", r"staffing", [("Bolt", "bolt")])]


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


@pytest.fixture
def tables(spark):
    rules = spark.createDataFrame(RULES, "key string, include string, exclude string, brands array<struct<brand: string, pattern: string>>")
    rows = [("1", "Acme Inc", "Engineer", "Python and SQL", "2023-01-02"), ("2", "Acme Labs", "Analyst", "nothing", "2023-03-04"), ("2", "Acme Labs", "Analyst", "nothing", "2023-03-04"), ("3", "Bolt", "Engineer", "SQL", "2023-02-01"), ("4", "Bolt Staffing", "Engineer", "SQL", "2023-02-01"), ("5", None, "x", "y", None)]
    return rules, rows, lambda r: spark.createDataFrame(r, "job_id string, company_name string, job_title string, job_description string, posting_date string").withColumn("source", F.lit("t"))


def test_runs(spark, tables):
    rules, rows, frame = tables
    root = f"{tempfile.mkdtemp(prefix='spark-')}/set"
    assert company_set.read_manifest(spark, root) is None
    assert company_set.build(frame(rows), rules, root, TAXONOMY) == ["acme", "bolt"]
    first = {r.company_key: r for r in company_set.read_manifest(spark, root).collect()}
    assert (first["acme"].postings, first["acme"].postings_with_skills, first["acme"].skill_coverage, first["acme"].distinct_skills, first["acme"].brands) == (2, 1, 0.5, 2, "Acme (1), Acme Labs (1)")
    assert first["bolt"].postings == 1 and str(first["bolt"].first_posting) == "2023-02-01"
    held = files(root)
    # the same rows in another order and more partitions: nothing is written
    assert company_set.build(frame(rows[::-1]).repartition(5), rules, root, TAXONOMY) == [] and files(root) == held
    # one company changes: its partition and a manifest are new, the other's files stay
    more = [*rows, ("6", "Bolt GmbH", "Engineer", "Python", "2023-05-01")]
    assert company_set.build(frame(more), rules, root, TAXONOMY) == ["bolt"]
    after = files(root)
    assert {f: t for f, t in after.items() if "company_key=acme" in f} == {f: t for f, t in held.items() if "company_key=acme" in f}
    assert not {f for f in after if "company_key=bolt" in f} & set(held)
    second = {r.company_key: r for r in company_set.read_manifest(spark, root).collect()}
    assert second["bolt"].postings == 2 and second["acme"].content == first["acme"].content and second["bolt"].content != first["bolt"].content
    assert spark.read.parquet(f"{root}/postings").groupBy("company_key").count().count() == 2 and spark.read.parquet(f"{root}/postings").count() == 4
    # a run with one company leaves the other in the manifest
    assert company_set.build(frame([("9", "Acme", "Engineer", "SQL", "2023-06-01")]), rules, root, TAXONOMY) == ["acme"]
    third = {r.company_key: r.postings for r in company_set.read_manifest(spark, root).collect()}
    assert third == {"acme": 1, "bolt": 2}


def test_a_lost_run_is_made_good(spark, tables):
    """Partitions without their manifest, as a run leaves them that ends between its two writes, are written again."""
    rules, rows, frame = tables
    root = f"{tempfile.mkdtemp(prefix='spark-')}/set"
    frame(rows).limit(1).withColumn("company_key", F.lit("acme")).write.partitionBy("company_key").parquet(f"{root}/postings")
    assert company_set.build(frame(rows), rules, root, TAXONOMY) == ["acme", "bolt"]
    assert spark.read.parquet(f"{root}/postings").count() == 3


def test_nothing_known(spark, tables):
    rules, rows, frame = tables
    root = f"{tempfile.mkdtemp(prefix='spark-')}/set"
    assert company_set.build(frame(rows[-1:]), rules, root, TAXONOMY) == [] and company_set.read_manifest(spark, root) is None


def test_large_names_are_joined_in_parts(spark, monkeypatch):
    """A name with many postings is dealt to several keys of the join; every posting keeps its one row."""
    monkeypatch.setattr(text, "NAME_ROWS", 10)
    postings = spark.createDataFrame([(k, "Google" if k % 4 else "Waymo Labs" if k % 8 else None) for k in range(200)], "id int, company_name string")
    rules = spark.createDataFrame([("google", "google|waymo", "", [("Waymo", "waymo")])], "key string, include string, exclude string, brands array<struct<brand: string, pattern: string>>")
    out = text.resolve_employers(postings, rules)
    assert out.columns == ["id", "company_name", "company_key", "company_brand"]
    assert sorted(r.id for r in out.collect()) == [k for k in range(200) if k % 8]
    assert "_part" in out._jdf.queryExecution().optimizedPlan().toString()
