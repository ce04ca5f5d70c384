"""Centroid clustering whose bounds stand in heaps, so that a round rescans only the vectors whose assignment is in doubt.

Components are whole numbers, so that sums, centroids and distances are exact. Vectors stand in blocks. A block keeps, for each
cluster, a binary heap of its members by the gap between the lower bound of the distance to any other centroid and the upper
bound of the distance to their own. Centroids that drift shrink the gaps of a cluster alike: the drift is added up in one
offset a cluster, and a gap holds the offset of the time when it was measured. A round pops the gaps at or below the offset, compares
those vectors with all centroids and puts them back; the others are not touched. A gap above zero leaves no tie.

Blocks and heaps are tables bucketed by block: a round joins them without a shuffle, and writes the heaps anew in the shared
folder, so that a lost executor costs a re-read only. Only sums of what moved meet: k times (components + 1) whole numbers.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmeter.llm.common import durable, ensure_checkpoint_dir, remove_at_end, remove_table

#: Vectors of a block and of a bucket: a task holds one bucket, some 16 MB. Spark allows so many buckets.
BLOCK, BUCKET, MOST_BUCKETS = 2048, 65_536, 100_000
#: Components at or above this (in units of 1/scale) would overflow a long when 64 of them are squared and summed.
MOST_UNITS = 1 << 27
#: Relative room for rounding in bounds; it only makes vectors be rescanned early.
SLACK = 1e-12


def expired(gaps: np.ndarray, limit: float) -> np.ndarray:
    """Places in a heap whose gap is at or below limit, found from the root: children of a larger gap are not looked at."""
    found, level = [], np.zeros(min(1, len(gaps)), np.int64)
    while len(level):
        level = level[gaps[level] <= limit]
        found.append(level)
        level = np.concatenate([2 * level + 1, 2 * level + 2])
        level = level[level < len(gaps)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def heap_order(gaps: np.ndarray) -> np.ndarray:
    """An order in which gaps form a binary heap (no child below its parent). Subtrees of one level sink together."""
    gaps, order = gaps.copy(), np.arange(len(gaps))
    inner = len(gaps) // 2
    for depth in range(inner.bit_length() - 1, -1, -1):
        at = np.arange((1 << depth) - 1, min((2 << depth) - 1, inner))
        while len(at):
            left = 2 * at + 1
            right = np.minimum(left + 1, len(gaps) - 1)
            least = np.where(gaps[right] < gaps[left], right, left)
            sinks = gaps[least] < gaps[at]
            at, least = at[sinks], least[sinks]
            for x in (gaps, order):
                x[at], x[least] = x[least], x[at]
            at = least[2 * least + 1 < len(gaps)]
    return order


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows of x to every centroid."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x.astype(np.int64) - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest centroid (ties: the smaller number) and the gap to keep in that cluster's heap."""
    squares = squared_distances(x, centroids)
    own = squares.argmin(axis=1)
    upper = np.sqrt(squares[np.arange(len(x)), own].astype(np.float64))
    if len(centroids) == 1:
        return own, np.full(len(x), np.inf)
    squares[np.arange(len(x)), own] = np.iinfo(np.int64).max
    lower = np.sqrt(squares.min(axis=1).astype(np.float64))
    gap, offset = lower - upper, offsets[own]
    return own, gap + offset - SLACK * (lower + upper + offset)


class Heaps:
    """The heaps of one block: rows and gaps of each cluster in heap order."""

    def __init__(self, rows: list[np.ndarray], gaps: list[np.ndarray]):
        self.rows, self.gaps = rows, gaps

    @classmethod
    def read(cls, row: dict, k: int) -> Heaps:
        ends = np.cumsum(row["sizes"])[:-1] if k > 1 else []
        return cls(np.split(np.frombuffer(row["members"], np.int32), ends), np.split(np.frombuffer(row["gaps"], np.float64), ends))

    @classmethod
    def new(cls, k: int) -> Heaps:
        return cls([np.zeros(0, np.int32)] * k, [np.zeros(0)] * k)

    def put(self, rows: np.ndarray, clusters: np.ndarray, gaps: np.ndarray) -> None:
        for j in np.unique(clusters):
            here = clusters == j
            members, all_gaps = np.concatenate([self.rows[j], rows[here].astype(np.int32)]), np.concatenate([self.gaps[j], gaps[here]])
            order = heap_order(all_gaps)
            self.rows[j], self.gaps[j] = members[order], all_gaps[order]

    def pop(self, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose gap has run out, and the clusters that they were in."""
        rows, clusters = [], []
        for j, limit in enumerate(limits):
            at = expired(self.gaps[j], limit)
            if len(at):
                rows.append(self.rows[j][at])
                clusters.append(np.full(len(at), j))
                left, gaps = np.delete(self.rows[j], at), np.delete(self.gaps[j], at)
                order = heap_order(gaps)
                self.rows[j], self.gaps[j] = left[order], gaps[order]
        none = np.zeros(0, np.int64)
        return np.concatenate(rows).astype(np.int64) if rows else none, np.concatenate(clusters) if clusters else none

    def clusters(self) -> np.ndarray:
        out = np.empty(sum(map(len, self.rows)), np.int64)
        for j, rows in enumerate(self.rows):
            out[rows] = j
        return out


def advance(heaps: Heaps | None, x: np.ndarray, centroids: np.ndarray, offsets: np.ndarray) -> tuple[Heaps, np.ndarray]:
    """Brings a block's heaps up to date with the centroids; also how each cluster's sums and size changed (k rows)."""
    k, dims = centroids.shape
    if heaps is None:
        heaps, rows, before = Heaps.new(k), np.arange(len(x)), None
    else:
        rows, before = heaps.pop(offsets * (1 + SLACK))
    own, gaps = nearest(x[rows], centroids, offsets)
    heaps.put(rows, own, gaps)
    change = np.zeros((k, dims + 1), np.int64)
    moved = np.ones(len(rows), bool) if before is None else before != own
    whole = np.column_stack([x[rows[moved]].astype(np.int64), np.ones(int(moved.sum()), np.int64)])
    for j in range(k):
        change[j] += whole[own[moved] == j].sum(axis=0)
        if before is not None:
            change[j] -= whole[before[moved] == j].sum(axis=0)
    return heaps, change


class _Bucketed:
    """Tables bucketed by block in the shared checkpoint folder."""

    def __init__(self, spark, buckets: int):
        ensure_checkpoint_dir(spark)
        self.spark, self.buckets = spark, buckets

    def write(self, df: DataFrame) -> DataFrame:
        name = f"blocks_{uuid.uuid4().hex}"
        at = f"{self.spark.sparkContext.getCheckpointDir()}/{name}"
        df.write.format("parquet").bucketBy(self.buckets, "block").sortBy("block").option("path", at).saveAsTable(name)
        remove_at_end(self.spark, at)
        out = self.spark.table(name)
        out._durable_at, out._name = at, name
        return out

    def drop(self, df: DataFrame) -> None:
        self.spark.sql(f"drop table {df._name}")
        remove_table(self.spark, df._durable_at)


def _blocks(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """block, ids, x: whole-numbered components of up to BLOCK vectors of a task."""

    def cut(batches):
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                units = np.floor(x.astype(np.float64) * scale).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([units.tobytes()], pa.binary())], names=["block", "ids", "x"])
                block += 1

    return kept.mapInArrow(cut, "block long, ids array<long>, x binary")


_STATE = "block long, members binary, gaps binary, sizes array<int>, change array<long>"


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    k, dims = centroids.shape
    fresh = state is None

    def go(batches):
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["x"], np.int32).reshape(-1, dims)
                heaps, change = advance(None if fresh else Heaps.read(row, k), x, centroids, offsets)
                out = {"block": [row["block"]], "members": [np.concatenate(heaps.rows).tobytes()], "gaps": [np.concatenate(heaps.gaps).tobytes()], "sizes": [list(map(len, heaps.rows))], "change": [change.ravel()]}
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("members", pa.binary()), ("gaps", pa.binary()), ("sizes", pa.list_(pa.int32())), ("change", pa.list_(pa.int64()))]))

    with_state = blocks.select("block", "x") if fresh else blocks.select("block", "x").join(state.drop("change"), "block")
    return with_state.mapInArrow(go, _STATE)


def _assigned(blocks: DataFrame, state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """block, ids, clusters, distances: every vector's cluster and its exact squared distance to that centroid."""
    k, dims = centroids.shape

    def measure(batches):
        for b in batches:
            for n, row in enumerate(b.select(["x", "members", "gaps", "sizes"]).to_pylist()):
                x = np.frombuffer(row["x"], np.int32).reshape(-1, dims).astype(np.int64)
                own = Heaps.read(row, k).clusters()
                d = x - centroids[own]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), v) for v in (pa.array(own, pa.int32()), pa.array(np.einsum("ij,ij->i", d, d)))]
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(n, 1), *lists], names=["ids", "clusters", "distances"])

    joined = blocks.join(state.drop("change"), "block")
    return joined.mapInArrow(measure, "ids array<long>, clusters array<int>, distances array<long>")


def _sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", watch=None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector (columns vec_id and embedding) that is kept.

    Kept are vectors of exactly dims components, none null, non-finite or of MOST_UNITS / scale or more in size; other columns are not read.
    Components become floor(scale * x). The first centroids are the k kept vectors with the least sha256 of salt and vec_id; with fewer vectors there are
    fewer centroids. Each round assigns every vector to the nearest centroid (ties: the smaller number) and replaces each centroid that has vectors by the floor of
    their mean; at the end they are assigned once more. Repeated vec_ids and repeated rows are vectors of their own (among equal hashes the least
    components come first); a null vec_id is carried, and comes last among the first centroids. No vectors: no rows.
    watch, if given, is called with every round's number and DataFrame of heaps.
    """
    spark = vectors.sparkSession
    fit = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST_UNITS / scale)
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter((F.size("embedding") == dims) & F.forall("embedding", fit))
    first = kept.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "embedding").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.floor(np.array([r[1] for r in first]) * scale).astype(np.int64)
    k = len(centroids)

    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-vectors.count() // BUCKET)))
    store = _Bucketed(spark, buckets)
    blocks = store.write(_blocks(kept, dims, scale).repartition(buckets, "block"))
    offsets, total, state = np.zeros(k), np.zeros((k, dims + 1), np.int64), None
    for n in range(rounds + 1):
        old, state = state, store.write(_round(blocks, state, centroids, offsets))
        if old is not None:
            store.drop(old)
        if watch:
            watch(n, state)
        if n < rounds:
            changes = state.select(F.posexplode("change").alias("at", "by")).groupBy("at").agg(F.sum("by").alias("by")).collect()
            for at, by in changes:
                total[divmod(at, dims + 1)] += by
            some = total[:, dims] > 0
            moved = centroids.copy()
            moved[some] = total[some, :dims] // total[some, dims:]
            drift = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
            offsets = offsets + drift + np.array([max(np.delete(drift, j), default=0.0) for j in range(k)])
            centroids = moved
    found = durable(_assigned(blocks, state, centroids))
    store.drop(state)
    store.drop(blocks)
    out = found.select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("v")).select(F.col("v.ids").alias("vec_id"), F.col("v.clusters").alias("cluster"), F.col("v.distances").alias("distance"))
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return out.select(
        "*",
        of([inertia.get(j, 0) for j in range(k)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(map(_sha256, centroids)).alias("centroid_sha256"),
    )


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """DuckDB SQL for cluster()'s rows over the table embeddings: plain rounds over all vectors."""
    square = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(d=dims)
    ctes = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(CAST(e AS DOUBLE)) < {MOST_UNITS // scale})) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('{salt}' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT v.vec_id, v.x, arg_min(c.j, ({square}, c.j)) AS j, CAST(min({square}) AS BIGINT) AS d FROM v, c{n} c GROUP BY v.rowid_, v.vec_id, v.x)")
        if n < rounds:
            ctes.append(f"s{n} AS (SELECT j, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {dims} + 1)) AS i) GROUP BY j, i)")
            floor = "CAST((s - (((s % n) + n) % n)) // n AS BIGINT)"
            ctes.append(f"m{n} AS (SELECT j, list({floor} ORDER BY i) AS x FROM s{n} GROUP BY j)")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (j))")
    ctes[0] = ctes[0].replace("SELECT vec_id", "SELECT row_number() OVER () AS rowid_, vec_id", 1).replace("v AS (", "v AS MATERIALIZED (", 1)
    last = rounds
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c USING (j)"
    )
