"""Shared pieces: reading tables, durable intermediate tables, byte tokens and 64-bit hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which alone separates words.
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir. Where none is configured, only a local master gets a folder of its own:
    executors of a cluster would not see the driver's."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))


def durable(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared checkpoint folder and reads it back: a lost executor then costs a re-read only.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    remove_at_end(spark, at)
    out = spark.read.schema(df.schema).parquet(at)
    out._durable_at = at
    return out


def discard(df: DataFrame) -> None:
    """Removes the table of a DataFrame that durable() returned, before the application ends."""
    remove_table(df.sparkSession, df._durable_at)


def remove_at_end(spark: SparkSession, at: str) -> None:
    atexit.register(remove_table, spark, at)


def remove_table(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: The column that holds a row's own columns while an operator works on it.
ROW = "_row"


def set_aside(docs: DataFrame, *needed: str, kept: list[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """docs as the needed columns and one struct of all (or the kept) columns, and the columns that restore these: an operator may add any
    names meanwhile, none can clash with docs' own."""
    names = docs.columns if kept is None else kept
    lean = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(ROW), *(F.col(c).alias(c) for c in needed))
    return lean, [F.col(ROW).getField(c).alias(c) for c in names]


#: Rows of one key that a task of spread_join takes, and most keys that it deals out (its broadcast: a key and a number each, some 16 MB).
KEY_ROWS, HOT_KEYS = 100_000, 1_000_000


def spread_join(left: DataFrame, right: DataFrame, key: str, over: list[str], most: int = KEY_ROWS) -> DataFrame:
    """left.join(right, key), where one key may hold any share of left's rows.

    Rows of a key with more than `most` of them are dealt to several parts by a hash of the columns over, and right's rows of that key are repeated for each part. left is
    read three times, so it should be a table. Keys are dealt out if they have more than `most` rows and more than one in HOT_KEYS of all, so they are
    HOT_KEYS at most."""
    counted = left.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > max(most, left.count() // HOT_KEYS))
    hot = F.broadcast(counted.select(key, F.ceil(F.col("_rows") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*over), parts).cast("int")).drop("_parts")
    each = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each, [key, "_part"]).drop("_part")


def let(value: Column, body) -> Column:
    """Evaluates value once per row and binds it for body (a higher-order function over a one-element array)."""
    return F.transform(F.array(value), body)[0]


def byte_column(column: pa.ChunkedArray | pa.Array) -> list:
    """Texts of an Arrow column as bytes objects (None for null)."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space; bytes.split() uses exactly \\x20 and \\x09-\\x0D."""
    return text.split() if text else []


class Memo(dict):
    """A dict that computes missing values, emptied when it holds `most` entries: worker memory stays bounded."""

    def __init__(self, compute, most: int = 400_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def token_hashes(most: int = 400_000) -> Memo:
    return Memo(xxhash.xxh64_intdigest, most)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batches_of(texts: list, most_bytes: int = 4_000_000):
    """Runs [lo, hi) over texts holding about most_bytes each, so that temporary arrays stay small."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most_bytes:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
