"""Exact substring deduplication with a log-structured index of fingerprints.

Every run of 35 words that stands at two places or more is found in three steps.

1. Each window of 35 words names one fingerprint of its own: the least hash among its sub-windows of 20 words. Equal
   windows name equal fingerprints, and neighbouring windows mostly share one, so about one in nine words gives an entry.
   Entries go batch by batch into the index: each batch is merge-joined with the sorted immutable runs of earlier batches,
   then becomes a run itself; where more than FAN_IN runs wait, they are compacted before the next batch, and the replaced runs go.
2. Windows whose fingerprint the index has seen twice are candidates. They are verified by 94 bits of two hashes of the window.
3. Words covered by verified windows are removed.

An index with a path outlives the application: later documents are merge-joined with what earlier calls left there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.llm.common import batches_of, byte_column, discard, durable, mix64, token_hashes, words_of

WINDOW, SUB = 35, 20
#: Batches of one call, runs that may wait before they are compacted, windows a task resolves at once.
BATCHES, FAN_IN, HELD = 3, 1, 400_000
#: Bytes of texts that a task cuts into windows together, and words whose hash it keeps: with HELD they bound a worker's memory.
PIECE, WORDS = 2_000_000, 200_000
#: The candidate filter has BITS_EACH bits for each repeated fingerprint, rounded up to a power of two between these bounds. The upper one
#: bounds what is broadcast (64 MB); a filter that is fuller than meant only adds candidates, which are verified like any others.
BITS_EACH, LEAST_BITS, MOST_BITS = 4, 1 << 20, 1 << 29
#: Bits of the candidate filter that are packed together.
PAGE = 1 << 17
#: What a candidate row stands for: seen once in its lot; repeated within its lot; stands for such a window, or for history, to other lots.
ONCE, REPEATED, WITNESS = 0, 1, 2
_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = np.uint64(_MULTIPLIER), inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Hashes of all windows of given width over a row of token hashes, by differences of a running polynomial."""

    def __init__(self):
        self.up, self.down = _powers(1 << 16)

    def running(self, tokens: np.ndarray) -> np.ndarray:
        if len(tokens) >= len(self.up):
            self.up, self.down = _powers(2 * len(tokens))
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * self.up[: len(tokens)], out=total[1:])
        return total

    def windows(self, total: np.ndarray, width: int) -> np.ndarray:
        n = len(total) - width
        return mix64((total[width:] - total[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def least_of(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of every `width` consecutive ones, and the first place of it. width must be a power of two."""
    at = np.arange(len(values))
    step = 1
    while step < width:
        a, b, p, q = values[:-step], values[step:], at[:-step], at[step:]
        first = a <= b
        values, at = np.where(first, a, b), np.where(first, p, q)
        step *= 2
    return values, at


def _joined(texts: list, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of several texts end to end, each text's start, and for each token the words left from it in its text."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    get = ids.__getitem__
    tokens = np.fromiter((get(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(tokens))
    return tokens, starts, left


def _windows(hasher: Hasher, tokens: np.ndarray, left: np.ndarray):
    """For every window inside one text: its start, its hash, its fingerprint and the place that the fingerprint stands at."""
    if len(tokens) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none
    total = hasher.running(tokens)
    named, at = least_of(hasher.windows(total, SUB), WINDOW - SUB + 1)
    whole = np.flatnonzero(left[: len(named)] >= WINDOW)
    return whole, hasher.windows(total, WINDOW)[whole], named[whole], at[whole]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, n, batch): the fingerprints that docs' windows name and the places they stand at, summed within each piece of a task.

    batch: the index batch of the piece, dealt in turn. It is written with the entries, so that each stays in one batch however they are read.
    """

    def name(batches):
        ids, hasher, batch = token_hashes(WORDS), Hasher(), TaskContext.get().partitionId()
        for b in batches:
            texts = byte_column(b.column(0))
            for lo, hi in batches_of(texts, PIECE):
                tokens, _, left = _joined(texts[lo:hi], ids)
                _, _, named, at = _windows(hasher, tokens, left)
                _, first = np.unique(at, return_index=True)
                fp, n = np.unique(named[first], return_counts=True)
                yield pa.RecordBatch.from_pydict({"fp": fp.view(np.int64), "n": np.minimum(n, 2).astype(np.int8), "batch": np.full(len(fp), batch % BATCHES, np.int8)})
                batch += 1

    return docs.select("text").mapInArrow(name, "fp long, n tinyint, batch tinyint")


class FingerprintIndex:
    """Sorted immutable runs of (fp, n): n is 2 once a fingerprint stands at two places or more.

    With a path, runs are kept there as tables run-<number> and found again by the next index of that path. Should a compaction be
    cut short, replaced runs stay beside the new one: counts then are too large, which adds candidates but loses none.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.runs: list[tuple[DataFrame, str | None]] = []
        self.next = 0
        if path is not None:
            for name in sorted(self._complete(), key=lambda n: int(n.split("-")[1])):
                self.runs.append((spark.read.schema("fp long, n tinyint").parquet(f"{path}/{name}"), f"{path}/{name}"))
                self.next = int(name.split("-")[1]) + 1

    def _folder(self):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _complete(self) -> list[str]:
        """Runs whose writing has ended."""
        fs, folder = self._folder()
        found = fs.listStatus(folder) if fs.exists(folder) else []
        names = [f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName().startswith("run-")]
        return [n for n in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def _keep(self, entries: DataFrame) -> tuple[DataFrame, str | None]:
        run = entries.groupBy("fp").agg(F.least(F.sum("n"), F.lit(2)).cast("tinyint").alias("n")).sortWithinPartitions("fp")
        if self.path is None:
            return durable(run), None
        at = f"{self.path}/run-{self.next}"
        self.next += 1
        run.write.parquet(at)
        return self.spark.read.schema("fp long, n tinyint").parquet(at), at

    def _drop(self, run: tuple[DataFrame, str | None]) -> None:
        df, at = run
        if at is None:
            discard(df)
        else:
            fs, _ = self._folder()
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at), True)

    def add(self, batch: DataFrame) -> DataFrame:
        """Merges (fp, n) of a new batch against every run, keeps it as a run and returns (fp) now known to be repeated."""
        if len(self.runs) > self.fan_in:
            self.compact()
        new = self._keep(batch)
        repeated = new[0].filter("n > 1").select("fp")
        for run, _ in self.runs:
            repeated = repeated.union(new[0].select("fp").join(run.select("fp"), "fp", "left_semi"))
        self.runs.append(new)
        return durable(repeated.distinct())

    def compact(self) -> None:
        """Replaces all runs by one and removes them."""
        replaced, merged = self.runs, self.runs[0][0]
        for run, _ in replaced[1:]:
            merged = merged.union(run)
        self.runs = [self._keep(merged)]
        for run in replaced:
            self._drop(run)

    def close(self) -> None:
        """Removes the runs of an index that has no path."""
        if self.path is None:
            for run in self.runs:
                self._drop(run)
            self.runs = []


def _filter_of(repeated: DataFrame) -> np.ndarray:
    """A bit for each repeated fingerprint. Its size is bounded by MOST_BITS, so it may be broadcast; a chance hit only adds a candidate."""
    bits = LEAST_BITS
    wanted = BITS_EACH * repeated.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = F.pmod("fp", F.lit(bits))
    distinct = repeated.select(F.floor(place / PAGE).cast("int").alias("page"), (place % PAGE).cast("int").alias("bit")).distinct()

    def packed(key, table):
        page = np.zeros(PAGE, np.uint8)
        page[table.column("bit").to_numpy()] = 1
        return pa.Table.from_pydict({"page": pa.array([key[0].as_py()], pa.int32()), "packed": [np.packbits(page, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for page, data in distinct.groupBy("page").applyInArrow(packed, "page int, packed binary").toLocalIterator():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bytes(data), np.uint8)
    return out


def candidate_windows(docs: DataFrame, known) -> DataFrame:
    """docs (doc_id, own, judged, text) -> (h, doc_id, own, place) of windows whose fingerprint may be repeated; own: hash of the text.

    place holds a window's start (from bit 32 on), 30 more bits of its hash and its state. A window that a lot of HELD windows
    sees often leaves it as one WITNESS and as ranges, however hot it is. REPEATED rows need no partner: a chance h spreads them.
    """

    def find(batches):
        ids, hasher, seen = token_hashes(WORDS), Hasher(), known.value
        bits = len(seen) * 8
        held, size = [], 0

        def resolve():
            h, check, doc, own, at, judged = (np.concatenate(x) for x in zip(*held))
            if not len(h):
                return
            order = np.lexsort((check, h))
            s, c = h[order], check[order]
            same = np.append(False, (s[1:] == s[:-1]) & (c[1:] == c[:-1]))
            twice = same | np.append(same[1:], False)
            lead = np.flatnonzero(~same)
            one, many = order[lead[~twice[lead]]], order[lead[twice[lead]]]
            again = np.sort(order[twice])
            again = again[judged[again]]
            state = np.concatenate([np.where(judged[one], ONCE, WITNESS), np.full(len(many), WITNESS), np.full(len(again), REPEATED)])
            rows = np.concatenate([one, many, again])
            keep = np.ones(len(rows), bool)
            if len(again):  # windows that cover one another's words are stated by the first and last of each stretch only
                d, p = own[again], at[again]
                before = (d[1:-1] == d[:-2]) & (p[1:-1] == p[:-2] + 1)
                after = (d[1:-1] == d[2:]) & (p[1:-1] == p[2:] - 1)
                inner = np.zeros(len(again), bool)
                inner[1:-1] = before & after & (np.arange(1, len(again) - 1) % (WINDOW // 2) != 0)
                keep[len(one) + len(many) :] = ~inner
            rows, state = rows[keep], state[keep].astype(np.int64)
            place = (at[rows] << 32) | (check[rows] << 2) | state
            spread = mix64(own[rows].view(np.uint64) + at[rows].astype(np.uint64))
            none = doc[rows] == np.iinfo(np.int64).min
            columns = {"h": np.where(state == REPEATED, spread, h[rows]).view(np.int64), "doc_id": pa.array(doc[rows], mask=none), "own": own[rows], "place": place}
            yield pa.RecordBatch.from_pydict(columns)

        for b in batches:
            texts = byte_column(b.column("text"))
            doc = b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            own = b.column("own").to_numpy()
            judged = b.column("judged").to_numpy(zero_copy_only=False)
            for lo, hi in batches_of(texts, PIECE):
                tokens, starts, left = _joined(texts[lo:hi], ids)
                at, h, named, _ = _windows(hasher, tokens, left)
                place = named.view(np.int64) % bits  # as Spark's pmod
                maybe = (seen[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                at, h = at[maybe], h[maybe]
                check = (second_hash(tokens, at) >> np.uint64(34)).astype(np.int64)
                row = np.searchsorted(starts, at, side="right") - 1
                held.append((h, check, doc[lo:hi][row], own[lo:hi][row], at - starts[row], judged[lo:hi][row]))
                size += len(h)
                if size > HELD:
                    yield from resolve()
                    held, size = [], 0
        if held:
            yield from resolve()

    return docs.select("doc_id", "own", "judged", "text").mapInArrow(find, "h long, doc_id long, own long, place long")


def second_hash(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another hash of the windows that start at the given places, word by word and so independent of the running one."""
    out = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        out = (out ^ tokens[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def _repeated(rows: DataFrame) -> DataFrame:
    """(doc_id, own, at) of REPEATED rows and of ONCE rows whose window other rows have too: neighbours in order of hash."""

    def neighbours(batches):
        last, tail, flagged = None, None, False

        def stated(b):
            at = b.column("place").to_numpy() >> 32
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own"), pa.array(at.astype(np.int32))], names=["doc_id", "own", "at"])

        for b in batches:
            state = b.column("place").to_numpy() & 3
            if (state == REPEATED).any():
                yield stated(b.filter(pa.array(state == REPEATED)))
                b = b.filter(pa.array(state != REPEATED))
                state = state[state != REPEATED]
            if not b.num_rows:
                continue
            h, check = b.column("h").to_numpy(), (b.column("place").to_numpy() & 0xFFFFFFFF) >> 2
            as_last = last is not None and (h[0], check[0]) == last
            same = np.append(as_last, (h[1:] == h[:-1]) & (check[1:] == check[:-1]))
            twice = same | np.append(same[1:], False)
            if as_last and tail is not None and not flagged:
                yield stated(tail)
            picked = twice & (state == ONCE)
            if picked.any():
                yield stated(b.filter(pa.array(picked)))
            last, flagged = (h[-1], check[-1]), bool(picked[-1])
            tail = b.slice(b.num_rows - 1, 1) if state[-1] == ONCE else None

    check = F.col("place").bitwiseAND(F.lit(0xFFFFFFFC))
    return rows.repartition("h").sortWithinPartitions("h", check).mapInArrow(neighbours, "doc_id long, own long, at int")


def deduplicate(docs: DataFrame, keep_text: bool = False, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for) for every row of docs.

    Removes each word that a window of 35 words covers whose word sequence also starts anywhere else, same document
    included; all windows are judged on the input. With an index and history (the documents that the index has been given before),
    a window also counts as repeated where it starts in history; rows of history are not judged again and not returned.
    Texts of fewer than 35 words, empty and null ones lose nothing. Repeated rows are copies of each other, so each loses all that its
    windows cover. A null doc_id is carried through; columns other than doc_id and text are not read. No documents: no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    entries, own_index = durable(fingerprints(docs.select("text"))), index or FingerprintIndex(spark)
    hits = [own_index.add(entries.filter(F.col("batch") == k).select("fp", "n")) for k in range(BATCHES)]
    discard(entries)
    if index is None:
        own_index.close()
    repeated = hits[0]
    for more in hits[1:]:
        repeated = repeated.union(more)
    known = spark.sparkContext.broadcast(_filter_of(repeated.distinct()))
    for h in hits:
        discard(h)
    seen = docs.withColumn("judged", F.lit(True))
    if history is not None:
        seen = seen.union(history.select("doc_id", "text", F.xxhash64("text").alias("own"), F.lit(False).alias("judged")))
    matched = _repeated(candidate_windows(seen, known))
    covered = durable(matched.groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("at")).alias("starts")))
    covered = covered.withColumnRenamed("doc_id", "_id")
    joined = docs.join(covered, docs["doc_id"].eqNullSafe(covered["_id"]) & (docs["own"] == covered["own"]), "left").select("doc_id", "text", "starts")

    def cut(batches):
        for b in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, starts in zip(byte_column(b.column("text")), b.column("starts")):
                words = words_of(text)
                kept = words
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + WINDOW, -1)
                    kept = [w for w, c in zip(words, np.cumsum(gone)) if not c]
                text = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text.decode() if keep_text else None)
            columns = {"doc_id": b.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": digests}
            if keep_text:
                columns["kept_text"] = pa.array(kept_texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


#: DuckDB's statement of deduplicate(); it lists all windows, so it suits small tables only.
ORACLE_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select r, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW}
), h as (
  select r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) as h from s
), m as (
  select r, i from (select r, i, count(*) over (partition by h) as n from h) where n > 1
), g as (
  select r, list_distinct(flatten(list(range(i, i + {WINDOW})))) as gone from m group by r
), k as (
  select d.doc_id, d.w, coalesce(g.gone, []) as gone from d left join g using (r)
)
select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed,
  sha256(array_to_string(case when len(gone) = 0 then w else list_transform(list_filter(range(1, len(w) + 1), lambda j: not list_contains(gone, j)), lambda j: w[j]) end, ' ')) as kept_sha256
from k
"""
