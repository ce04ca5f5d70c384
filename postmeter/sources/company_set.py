"""A set of companies' postings, built anew only where a company changed, and the manifest that tells what stands there.

postings/company_key=<key>/ holds a company's featured postings; manifest/v=<n>/ holds the n-th manifest whole, the last one counts. A run writes the
partitions of companies whose content is another than the manifest says, by dynamic partition overwrite, and then a new manifest; it writes
nothing where nothing changed. A run that was lost between the two is made good by the next, which finds the old manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from postmeter.operators import skills, text
from postmeter.operators.skills import Skill
from postmeter.sources.tables import forbidden_columns, personal_columns, settled, to_shared_schema

#: Rows that one file of a company holds, about: a company with many postings is written by many tasks.
ROWS_A_FILE = 250_000


def featured_set(postings: DataFrame, rules: DataFrame, taxonomy: list[Skill], units: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """company_key, company_brand and the processed, featured columns of every posting of a known company: one row for a job_id and company."""
    known = text.resolve_employers(to_shared_schema(postings), rules)
    return skills.posting_features(text.preprocess(known), taxonomy, units)


def manifest_of(featured: DataFrame) -> DataFrame:
    """A row a company: postings, postings_with_skills, skill_coverage, distinct_skills, publishers, first_posting, last_posting, brands and content,
    a sum over the rows' hashes that changes with any value of any row and with nothing else."""
    own = [F.to_json(c) if featured.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in sorted(featured.columns)]
    content = F.sum(F.xxhash64(*own).cast("decimal(38,0)")).cast("string").alias("content")
    g = featured.groupBy("company_key").agg(
        F.count("*").alias("postings"), F.count(F.when(F.col("has_any_skill"), 1)).alias("postings_with_skills"), F.avg(F.col("has_any_skill").cast("double")).alias("skill_coverage"),
        F.countDistinct("job_via").alias("publishers"), F.min("posting_date").alias("first_posting"), F.max("posting_date").alias("last_posting"), content,
    )
    items = featured.select("company_key", F.explode("skills_final").alias("s")).groupBy("company_key").agg(F.countDistinct("s").alias("distinct_skills"))
    brands = featured.groupBy("company_key", "company_brand").agg(F.count("*").alias("n")).groupBy("company_key")
    listed = brands.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("company_brand").alias("b")))), lambda x: F.format_string("%s (%d)", x["b"], -x["n"])), ", ").alias("brands"))
    return g.join(items, "company_key", "left").na.fill(0, ["distinct_skills"]).join(listed, "company_key")


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The last manifest of a set, or None before the first run."""
    try:
        every = spark.read.parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = every.agg(F.max("v")).first()[0]
    return every.filter(F.col("v") == last)


def build(postings: DataFrame, rules: DataFrame, root: str, taxonomy: list[Skill], units: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Brings the set at root up to date with the companies of postings and returns the keys of those that were written.

    Companies of the manifest that postings don't hold stay as they are, so a run may bring one company only. postings: columns of the shared
    schema, missing ones are null; repeated job_ids count once. Raises ValueError if the manifest had a column that must not be published."""
    spark = postings.sparkSession
    featured = settled(featured_set(postings, rules, taxonomy, units))
    now = settled(manifest_of(featured))
    if forbidden_columns(now) + personal_columns(now):
        raise ValueError("the manifest has columns that must not be published")
    before = read_manifest(spark, root)
    changed = now if before is None else now.join(before.select("company_key", "content"), ["company_key", "content"], "left_anti")
    sizes = {r.company_key: r.postings for r in changed.select("company_key", "postings").collect()}  # a row a company
    if not sizes:
        return []
    files = sum(-(-n // ROWS_A_FILE) for n in sizes.values())
    # By range: hashes of so few keys would put several files' rows into one task and none into others.
    rows = featured.join(changed.select("company_key"), "company_key", "left_semi").repartitionByRange(files, "company_key", F.xxhash64("job_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company_key").parquet(f"{root}/postings")
    kept = [] if before is None else [before.drop("v").join(changed.select("company_key"), "company_key", "left_anti")]
    version = 1 if before is None else before.select("v").first()[0] + 1
    whole = changed
    for other in kept:
        whole = whole.unionByName(other)
    settled(whole).coalesce(1).withColumn("v", F.lit(version)).write.mode("append").partitionBy("v").parquet(f"{root}/manifest")
    return sorted(sizes)
