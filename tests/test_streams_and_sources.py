"""Streaming aggregates equal their batch tables on bounded input; the shared schema; the power of a sign test."""

import datetime as dt

from pyspark.sql import functions as F

from postmeter.operators import values, volume
from postmeter.sources import tables
from postmeter.streaming import volume as streaming


def drained(stream, spark, name):
    stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def postings(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").select(F.col("event_type").alias("entity"), F.col("user_id").cast("string").alias("publisher"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def test_stream_batches_equal_the_batch_table(spark, small, tmp_path):
    e, stream = postings(spark, small, tmp_path)
    got = drained(streaming.batches(stream), spark, "stream_batches")
    want = volume.batch_table(e.withColumn("day", F.to_date("ts")))
    key = ["entity", "publisher", "day", "postings"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_stream_sessions(spark, small, tmp_path):
    """Every posting is in one session, and two sessions of a publisher are the gap apart at least."""
    e, stream = postings(spark, small, tmp_path)
    got = sorted(map(tuple, drained(streaming.sessions(stream), spark, "stream_sessions").collect()))
    assert sum(r[3] for r in got) == e.count()
    assert all(a[0] != b[0] or b[1] >= a[2] for a, b in zip(got, got[1:]))


def test_shared_schema(spark):
    rows = [("j1", "b", "2023-01-02", "u2"), ("j1", "a", "2023-01-03", "u1"), ("j2", None, None, None)]
    df = spark.createDataFrame(rows, "job_id string, source string, posting_date string, job_url string")
    out = tables.to_shared_schema(df)
    got = {r.job_id: r for r in out.collect()}
    assert out.columns == [c.split()[0] for c in tables.RAW_SCHEMA.split(", ")] and len(got) == 2
    assert got["j1"].source == "a" and got["j1"].posting_date == dt.date(2023, 1, 3) and got["j2"].company_name is None


def test_sign_test_power(spark):
    got = [r.p_value for r in values.sign_test_power(spark, 4).orderBy("n").collect()]
    assert [round(p, 6) for p in got] == [1.0, 0.5, 0.25, 0.125]
