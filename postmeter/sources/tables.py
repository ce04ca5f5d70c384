"""Readers with explicit schemas and a writer that refuses columns which must not be published."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that no published table may have, and substrings that mark personal data (a company's name is none).
BANNED = ("country", "location_country", "share_of_all")
PERSONAL = ("email", "phone", "first_name", "last_name", "full_name", "recruiter", "applicant", "candidate", "address", "birth", "gender", "linkedin", "contact", "ssn")
#: The shared schema of raw postings.
RAW_SCHEMA = (
    "job_id string, company_name string, job_title string, job_description string, posting_date date, location string, job_url string, employment_type string, remote boolean, country string, "
    "salary_year_avg double, extracted_skills string, skill_categories string, job_via string, source string, scraped_date string"
)


def forbidden_columns(df: DataFrame) -> list[str]:
    return sorted(set(df.columns) & set(BANNED))


def personal_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c != "company_name" and any(p in c.lower() for p in PERSONAL))


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A parquet, csv, json or orc table; text formats take a schema, so nothing is inferred by an extra pass."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        if schema is None:
            raise ValueError("a csv table needs a schema")
        reader = reader.option("header", True)
    elif kind not in ("parquet", "json", "orc"):
        raise ValueError(f"unknown kind {kind!r}")
    return reader.format(kind).load(path)


def to_shared_schema(df: DataFrame) -> DataFrame:
    """The shared columns in order, missing ones null, one row for each job_id: the first by source, date and url."""
    from pyspark.sql import Window

    kinds = dict(c.split() for c in RAW_SCHEMA.split(", "))
    out = df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    first = Window.partitionBy("job_id").orderBy("source", "posting_date", "job_url", "job_title")
    return out.withColumn("_at", F.row_number().over(first)).filter("_at = 1").drop("_at")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes a table after checking its columns."""
    wrong = forbidden_columns(df) + personal_columns(df)
    if wrong:
        raise ValueError(f"columns that must not be published: {wrong}")
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only a local master gets one of its own where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the cluster's shared folder and read back: what several tables build on is then scanned, not computed anew.

    The table goes with the application."""
    spark = df.sparkSession
    at = f"{checkpoint_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(remove, spark, at)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    sc = spark.sparkContext
    if sc._jvm is not None and sc._jsc is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
