"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the tokens in a stretch of a text and ignore the rest, so a passage keeps most of its hashes when
words are replaced. Hashes of the benchmark are a table; a broadcast filter of bounded size lets through the few hashes of documents
that may be in it, and these are joined with the table. Along each diagonal that a hit names, the two texts are compared token by token.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmeter.llm.common import Memo, batches_of, durable, mix64, set_aside, spread_join

#: The masks; 1 is a token that counts, 0 one that is ignored.
MASKS = ("111111", "1101011", "110010111", "1011000111")
#: A verified overlap has at least so many aligned tokens (the whole item if it is shorter), this share of them equal.
MIN_TOKENS, MIN_EQUAL = 12, 0.8
#: The filter has BITS_EACH bits for each hash of the benchmark, rounded up to a power of two between these bounds, of which PROBES are set: about
#: one in 100,000 other hashes passes. The upper bound limits what is broadcast (64 MB). A fuller filter lets more through to the join, which is exact.
BITS_EACH, PROBES, LEAST_BITS, MOST_BITS = 32, 8, 1 << 20, 1 << 29
#: Bits of the filter that are packed together.
PAGE = 1 << 17
ADDED = ("contaminated", "n_items", "item_ids", "best_overlap")
_TOKEN = re.compile(r"\w+")


def block_masks(n: int) -> list[str]:
    """Masks of n tokens of which one at least keeps clear of as many unequal tokens as a stretch of n may have.

    n is cut into two pieces more than these, so two pieces are untouched: one mask counts the tokens of each two."""
    errors = max(k for k in range(n) if n - k >= MIN_EQUAL * n)
    pieces = np.array_split(np.arange(n), errors + 2)
    return ["".join("01"[k in a or k in b] for k in range(n)) for a, b in combinations(pieces, 2)]


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every place of tokens where it fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) * 1_000_003 + int(mask, 2), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    return mix64(out)


def masks_for(sizes: list[int]) -> dict[int, list[str]]:
    """Masks by the size of item that they are for; 0: every item. Items of fewer tokens than a stretch have to be found whole."""
    out = {0: [*MASKS, *block_masks(MIN_TOKENS)]}
    for n in sizes:
        if n < MIN_TOKENS:
            out[n] = block_masks(n) if n >= len(MASKS[0]) else ["1" * n]
    return out


def _coded(texts: list, ids: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of several texts end to end, and the number of tokens in each."""
    words = [tokens_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    get = ids.__getitem__
    return np.fromiter((get(w) for ws in words for w in ws), np.uint64, int(sizes.sum())), sizes


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, n, tokens): each distinct text of the benchmark that has tokens, with its token hashes; and (item, id): the ids that it has there."""
    own = benchmark.filter("item_id is not null and text is not null").select(F.xxhash64("text").alias("item"), F.col("item_id").alias("id"), "text")

    def code(batches):
        memo = Memo(_hash)
        for b in batches:
            tokens = [_coded([t], memo)[0].view(np.int64) for t in b.column("text").to_pylist()]
            sizes = pa.array([len(t) for t in tokens], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("item"), sizes, pa.array(tokens, pa.list_(pa.int64()))], names=["item", "n", "tokens"])

    texts = own.select("item", "text").dropDuplicates(["item"])
    return texts.mapInArrow(code, "item bigint, n int, tokens array<bigint>").filter("n > 0"), own.select("item", "id").distinct()


def seeds_of(items: DataFrame, masks: dict[int, list[str]]) -> DataFrame:
    """(h, item, at): every mask's hash at every place of every item."""

    def seed(batches):
        for b in batches:
            for item, tokens in zip(b.column("item").to_pylist(), b.column("tokens")):
                t = tokens.values.to_numpy().view(np.uint64)
                found = [_seeds(t, m) for n, ms in masks.items() if n in (0, len(t)) for m in ms]
                h = np.concatenate(found)
                at = np.concatenate([np.arange(len(f)) for f in found])
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "item": np.full(len(h), item, np.int64), "at": at.astype(np.int32)})

    return items.select("item", "tokens").mapInArrow(seed, "h long, item long, at int")


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The place that probe k of each hash has in a filter of a power of two bits."""
    return ((h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def passes(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in h of the hashes that the filter lets through."""
    at = np.arange(len(h))
    for k in range(PROBES):
        place = _probe(h[at], k, len(known) * 8)
        at = at[(known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
    return at


def filter_of(seeds: DataFrame) -> np.ndarray:
    """The filter of the benchmark's hashes. Pages of it are packed by tasks; its size is bounded by MOST_BITS."""
    bits, wanted = LEAST_BITS, BITS_EACH * seeds.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def deal(batches):
        for b in batches:
            h = np.unique(b.column("h").to_numpy()).view(np.uint64)
            place = np.unique(np.concatenate([_probe(h, k, bits) for k in range(PROBES)]))
            yield pa.RecordBatch.from_pydict({"page": (place // PAGE).astype(np.int32), "bit": (place % PAGE).astype(np.int32)})

    def packed(key, table):
        page = np.zeros(PAGE, np.uint8)
        page[table.column("bit").to_numpy()] = 1
        return pa.Table.from_pydict({"page": pa.array([key[0].as_py()], pa.int32()), "packed": [np.packbits(page, bitorder="little").tobytes()]})

    distinct = seeds.select("h").mapInArrow(deal, "page int, bit int").distinct()
    out = np.zeros(bits // 8, np.uint8)
    for page, data in distinct.groupBy("page").applyInArrow(packed, "page int, packed binary").toLocalIterator():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bytes(data), np.uint8)
    return out


def hits_of(docs: DataFrame, masks: dict[int, list[str]], shared) -> DataFrame:
    """docs (doc_id, own, text) -> one row for each document with hashes that the filter lets through: doc_id, own, hits (h, at), tokens."""
    every = [m for ms in masks.values() for m in ms]
    hit = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))

    def search(batches):
        known, ids = shared.value, Memo(_hash)
        for b in batches:
            texts = b.column("text").to_pylist()
            rows, hits, kept = [], [], []
            for lo, hi in batches_of(texts):
                tokens, sizes = _coded(texts[lo:hi], ids)
                ends = np.cumsum(sizes)
                found_h, found_at = [], []
                for m in every:
                    s = _seeds(tokens, m)
                    at = passes(known, s)
                    row = np.searchsorted(ends, at, side="right")
                    at = at[at + len(m) <= ends[row]] if len(at) else at  # a hash over two texts is none of either
                    found_h.append(s[at])
                    found_at.append(at)
                h, at = np.concatenate(found_h), np.concatenate(found_at)
                row = np.searchsorted(ends, at, side="right")
                order = np.argsort(row, kind="stable")
                h, at, row = h[order], at[order], row[order]
                for k in np.unique(row):
                    i, j = np.searchsorted(row, [k, k + 1])
                    first = ends[k] - sizes[k]
                    rows.append(lo + int(k))
                    hits.append([{"h": x, "at": y} for x, y in zip(h[i:j].view(np.int64).tolist(), (at[i:j] - first).tolist())])
                    kept.append(tokens[first : ends[k]].view(np.int64))
            picked = b.select(["doc_id", "own"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(hits, hit), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "own", "hits", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(search, f"doc_id {kind}, own bigint, hits array<struct<h: bigint, at: int>>, tokens array<bigint>")


def overlap(same: np.ndarray, need: int) -> tuple[int, int] | None:
    """Of a diagonal's tokens (equal or not): the longest stretch (start, size) of at least `need` with the wanted share of equal ones.

    With running totals of "equal less MIN_EQUAL" a stretch qualifies where its end's total is not below its start's.
    """
    n = len(same)
    if n < need or same.sum() < MIN_EQUAL * need:
        return None
    # Whole numbers: five times equal less four times size, as MIN_EQUAL is 4 in 5.
    gain = np.append(0, np.cumsum(5 * same.astype(np.int64) - 4))
    least = np.minimum.accumulate(gain)
    # For every end the first start with a total no larger than the end's: least totals fall, so it is found by bisection.
    first = np.searchsorted(-least, -gain, side="left")
    size = np.arange(n + 1) - first
    k = int(size.argmax())
    return (int(first[k]), int(size[k])) if size[k] >= need else None


def found_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, own, text) -> (doc_id, own, items (id, share)) for every document in which a benchmark item is found."""
    sc = docs.sparkSession.sparkContext
    items, named = items_of(benchmark)
    items = durable(items)
    sizes = [r[0] for r in items.filter(F.col("n") < MIN_TOKENS).select("n").distinct().collect()]
    masks = masks_for(sizes)
    seeds = durable(seeds_of(items, masks))
    candidates = durable(hits_of(docs, masks, sc.broadcast(filter_of(seeds))))
    each = candidates.select("doc_id", "own", F.explode("hits").alias("x")).select("doc_id", "own", "x.h", "x.at")
    met = spread_join(each, seeds.withColumnRenamed("at", "place"), "h", ["doc_id", "own", "at"])
    diagonals = durable(met.select("doc_id", "own", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct())
    diagonals = spread_join(diagonals, items, "item", ["doc_id", "own", "diagonal"]).withColumnsRenamed({"tokens": "wanted", "doc_id": "_doc", "own": "_own"})
    same_doc = candidates["doc_id"].eqNullSafe(diagonals["_doc"]) & (candidates["own"] == diagonals["_own"])
    start = F.greatest("diagonal", F.lit(0))
    stretch = F.slice("tokens", start + 1, F.greatest(F.col("n") + F.col("diagonal") - start, F.lit(0)))
    pairs = candidates.drop("hits").join(diagonals, same_doc).select("doc_id", "own", "item", "n", F.greatest(-F.col("diagonal"), F.lit(0)).alias("from"), "wanted", stretch.alias("stretch"))

    def compare(batches):
        for b in batches:
            share = []
            for size, first, wanted, stretch in zip(b.column("n").to_pylist(), b.column("from").to_pylist(), b.column("wanted"), b.column("stretch")):
                x, y = wanted.values.to_numpy()[first:], stretch.values.to_numpy()
                n = min(len(x), len(y))
                got = overlap(x[:n] == y[:n], min(MIN_TOKENS, size))
                share.append(got[1] / size if got else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own"), b.column("item"), pa.array(share, pa.float64())], names=["doc_id", "own", "item", "share"])

    kind = pairs.schema["doc_id"].dataType.simpleString()
    verified = pairs.mapInArrow(compare, f"doc_id {kind}, own bigint, item bigint, share double").filter("share is not null")
    covered = durable(verified.groupBy("doc_id", "own", "item").agg(F.max("share").alias("share")))
    best = spread_join(covered, named, "item", ["doc_id", "own"]).groupBy("doc_id", "own", "id").agg(F.max("share").alias("share"))
    return best.groupBy("doc_id", "own").agg(F.sort_array(F.collect_list(F.struct("id", "share"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs plus contaminated (boolean), n_items (long), item_ids (string: sorted, comma-joined) and best_overlap (double).

    An item is found in a document when some stretch of at least 12 tokens (all of a shorter item) of both stands
    aligned with 80 % of its tokens equal; best_overlap is the largest share of an item that is covered so. Tokens are lower-cased runs of
    letters, digits and underscores. Null and empty texts and items contain nothing; null item ids are skipped; items of fewer tokens than the
    shortest mask must occur whole and unchanged; repeated rows are judged alike, a null doc_id by its text. Columns of docs by the
    added names are replaced. An empty table of documents or items gives no row or no finding.
    """
    docs, restored = set_aside(docs.drop(*ADDED), "doc_id", "text")
    keyed = docs.withColumn("_own", F.xxhash64("text"))
    found = durable(found_items(keyed.select("doc_id", F.col("_own").alias("own"), "text"), benchmark)).withColumnsRenamed({"doc_id": "_doc", "own": "_found_own"})
    out = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_doc"]) & (keyed["_own"] == found["_found_own"]), "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    return out.select(
        *restored,
        F.col("items").isNotNull().alias("contaminated"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ","), F.lit("")).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("items", lambda x: x["share"])), F.lit(0.0)).alias("best_overlap"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with docs' columns, in which no benchmark item is found. Only keys of those that go are joined."""
    own = F.xxhash64("text")
    found = durable(found_items(docs.select("doc_id", own.alias("own"), "text"), benchmark).select("doc_id", "own"))
    gone = found.withColumnsRenamed({"doc_id": "_doc", "own": "_gone"})
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_doc"]) & (own == gone["_gone"]), "left_anti")
