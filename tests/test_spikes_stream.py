"""The stream of spikes equals the spikes of all weeks at once."""

import datetime
import random
import tempfile

from pyspark.sql import functions as F

from postmeter.operators import volume
from postmeter.streaming import spikes


def test_stream_equals_all_weeks(spark):
    for k, v in spikes.STATE_STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(5)
    rows, n = [], 0
    for week in range(40):
        for e, size in (("a", 12), ("b", 2), ("c", 0 if week % 7 else 5)):
            for _ in range(size + rng.randrange(3) + (40 if (e, week) in (("a", 20), ("b", 15)) else 0)):
                at = datetime.datetime(2021, 1, 4) + datetime.timedelta(weeks=week, hours=rng.randrange(168))
                rows.append((n := n + 1, e, at))
    folder = tempfile.mkdtemp(prefix="spark-") + "/in"
    schema = "id long, entity string, ts timestamp"
    for k, part in enumerate(rows[i : i + 250] for i in range(0, len(rows), 250)):
        part = part + part[:20]  # rows that come twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    late = [(n + 1, "a", datetime.datetime(2020, 1, 1))]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = spikes.spikes(stream).writeStream.outputMode("append").format("memory").queryName("spiked").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        for k in spikes.STATE_STORE:
            spark.conf.unset(k)
    got = {(r.entity, r.start): r for r in spark.table("spiked").collect()}
    weekly = spark.createDataFrame(rows, schema).groupBy("entity", F.trunc("ts", "WEEK").alias("start")).count()
    ends = weekly.groupBy("entity").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    spine = ends.select("entity", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("start"))
    want = {(r.entity, r.start): r for r in volume.robust_spikes(spine.join(weekly, ["entity", "start"], "left").select("entity", "start", F.coalesce("count", F.lit(0)).alias("postings"))).collect()}
    assert set(got) <= set(want), sorted(set(got) - set(want))[:5]
    assert sum(k[0] == "a" for k in got) > 25, sorted(k for k in got)[-3:]
    for k, r in got.items():
        w = want[k]
        assert (r.postings, r.is_spike, r.is_trough) == (w.postings, w.is_spike, w.is_trough), k
        for c in ("local_median", "robust_z", "poisson_z"):
            assert (r[c] is None) == (w[c] is None) and (r[c] is None or abs(r[c] - w[c]) < 1e-9), (k, c)
    assert got["a", datetime.date(2021, 5, 24)].is_spike
