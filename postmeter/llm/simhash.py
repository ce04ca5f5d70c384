"""SimHash near-duplicates: fingerprints, a binary-trie self-join within a Hamming budget, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.llm.common import byte_column, durable, mix64, set_aside, token_hashes, words_of
from postmeter.llm.substring import Hasher

SHINGLE, SEED, BUDGET = 3, 42, 3
#: A fingerprint has BLOCKS blocks of BITS bits. Two of them within BUDGET (< BLOCKS) differing bits share a block.
BLOCKS, BITS = 4, 16
#: A bucket of more keys than SPLIT is dealt again by SUB_PARTS parts of SUB_BITS bits of the bits behind its block.
SPLIT, SUB_PARTS, SUB_BITS = 50_000, 4, 12
#: Node pairs expanded at once, and the most leaf pairs that one node pair may stand for before it is compared directly.
CHUNK, DIRECT = 200_000, 64
#: Wide fingerprints, for groups of near-duplicates: 64-bit words, words of a shingle, differing bits allowed in all and in one word. At a
#: similarity of 0.8 some 78 of 512 bits differ, give or take 8, and the budget is a deviation and a half above that; one 16-bit block of 32 is equal in nine of ten such pairs, in all but one of 500 at 0.9.
WORDS_WIDE, WIDE_SHINGLE, WIDE_BUDGET, WORD_BUDGET = 8, 5, 90, 24
_WIDE_SEEDS = np.array([(k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1) for k in range(WORDS_WIDE)], np.uint64)
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit integer. No words, or a null text: zero."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest = xxhash.xxh64_digest
    rows = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    if len(rows) < 256:
        counts = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BIT_TABLE for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """docs without text, plus `fp`: the fingerprint of each row's whole text as a long. Texts go to Python, but don't come back."""
    schema = docs.drop("text", "fp").schema.add("fp", "long")

    def add(batches):
        for b in batches:
            fps = [fingerprint(t) for t in byte_column(b.column("text"))]
            own = [b.column(n) for n in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(fps, pa.int64())], names=schema.names)

    return docs.mapInArrow(add, schema)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _roots(parent)


def _star(parent: np.ndarray, keys: np.ndarray, lo: int, hi: int, budget: int, verify) -> np.ndarray:
    """Holds keys against all others of their bucket, each time the first one that has no component yet, while that finds large ones."""
    left = np.arange(lo, hi)
    while len(left) > DIRECT:
        first, others = left[0], left[1:]
        near = others[np.bitwise_count(keys[others] ^ keys[first]) <= budget]
        near = near[verify(np.full(len(near), first), near)]
        parent = _unite(parent, np.full(len(near), first), near)
        if len(near) * 4 < len(others):
            break
        left = others[parent[others] == others]
    return parent


def trie_components(keys: np.ndarray, bounds: np.ndarray, depth: int, budget: int = BUDGET, verify=None) -> np.ndarray:
    """For sorted uint64 keys: each key's component root (an index), linking keys of one bucket within budget.

    bounds: starts of the buckets, whose keys share their first `depth` bits. A trie node is a range of the sorted keys.
    Pairs of nodes go down the trie together; a pair is dropped when the bits in which its paths differ exceed the budget,
    and compared directly once it stands for few leaves. Pending pairs wait on a stack in chunks, so memory stays bounded.

    verify(i, j), if given, says which pairs within budget link. Then the first key of each large bucket is held against all others
    beforehand, and node pairs within one component so found are dropped: a group of copies costs little, however large it is.
    """
    parent = np.arange(len(keys))
    run_end = None
    if verify is not None:
        for lo, hi in zip(bounds, np.append(bounds[1:], len(keys))):
            if hi - lo > DIRECT:
                parent = _star(parent, keys, lo, hi, budget, verify)
        change = np.flatnonzero(parent[1:] != parent[:-1]) + 1
        ends = np.append(change, len(keys))
        run_end = ends[np.searchsorted(change, np.arange(len(keys)), side="right")]
    lo, hi = bounds, np.append(bounds[1:], len(keys))
    stack = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while stack:
        d, pairs = stack.pop()
        a0, a1, b0, b1, diff = pairs
        na, nb, own = a1 - a0, b1 - b0, a0 == b0
        live = ~(own & (na == 1))
        if run_end is not None:
            live &= ~((run_end[a0] >= a1) & (run_end[b0] >= b1) & (parent[a0] == parent[b0]))
        few = live & ((na * nb <= DIRECT) | (d == 64))
        if few.any():
            p = pairs[:, few]
            w = p[3] - p[2]
            size = (p[1] - p[0]) * w
            which = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            i, j = p[0][which] + k // w[which], p[2][which] + k % w[which]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            i, j = i[near], j[near]
            if verify is not None:
                apart = parent[i] != parent[j]
                i, j = i[apart], j[apart]
                right = verify(i, j)
                i, j = i[right], j[right]
            parent = _unite(parent, i, j)
        rest = live & ~few
        if not rest.any():
            continue
        a0, a1, b0, b1, diff = pairs[:, rest]
        own = a0 == b0
        bit = np.uint64(63 - d)

        def middle(lo, hi):
            top = ((keys[lo] >> bit) | np.uint64(1)) << bit
            return np.minimum(np.maximum(np.searchsorted(keys, top), lo), hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        cross = ~own
        down = [
            np.stack([a0, am, b0, bm, diff]),
            np.stack([am, a1, bm, b1, diff]),
            np.stack([a0, am, bm, b1, diff + 1]),
            np.stack([am, a1, b0, bm, diff + 1])[:, cross],
        ]
        down = np.concatenate(down, axis=1)
        down = down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)]
        stack += [(d + 1, down[:, k : k + CHUNK]) for k in range(0, down.shape[1], CHUNK)]
    return parent


def whole_buckets(batches, read):
    """(turn, starts, *columns) of whole buckets, one turn at a time, from rows sorted by turn and bucket; starts: of each bucket.

    read gives a batch's arrays, turn and bucket first. A batch's last bucket may go on in the next one; it is joined with
    what comes there once it has ended."""
    held = []

    def ended(parts):
        turn, head, *columns = (np.concatenate(x) for x in zip(*parts))
        starts = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (turn[1:] != turn[:-1])))
        first = np.flatnonzero(np.append(True, turn[1:] != turn[:-1]))
        for lo, hi in zip(first, np.append(first[1:], len(turn))):
            yield turn[lo], starts[(starts >= lo) & (starts < hi)] - lo, *(c[lo:hi] for c in columns)

    for b in batches:
        part = read(b)
        if not len(part[0]):
            continue
        at = int(np.argmax((part[0] == part[0][-1]) & (part[1] == part[1][-1])))
        if held and at == 0 and (held[-1][0][-1], held[-1][1][-1]) == (part[0][0], part[1][0]):
            held.append(part)
            continue
        if at:
            yield from ended([*held, tuple(x[:at] for x in part)])
        elif held:
            yield from ended(held)
        held = [tuple(x[at:] for x in part)]
    if held:
        yield from ended(held)


def _stars(root: np.ndarray, ids: np.ndarray):
    """Edges (u, v) from every member of a component of two or more to its least id."""
    linked = np.bincount(root, minlength=len(ids))[root] > 1
    if not linked.any():
        return
    own, root = ids[linked], root[linked]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, own)
    out = own != least[root]
    yield pa.RecordBatch.from_pydict({"u": own[out], "v": least[root][out]})


def _turned(fp: Column, r: int) -> Column:
    """fp with block r rotated to the front."""
    return F.shiftleft(fp, r * BITS).bitwiseOR(F.shiftrightunsigned(fp, 64 - r * BITS)) if r else fp


def _subturned(key: Column, q: int) -> Column:
    """A turned key whose last 48 bits are rotated so that their part q stands behind the block."""
    if not q:
        return key
    rest, wide = 64 - BITS, q * SUB_BITS
    tail = key.bitwiseAND(F.lit((1 << rest) - 1))
    moved = F.shiftleft(tail, wide).bitwiseOR(F.shiftrightunsigned(tail, rest - wide)).bitwiseAND(F.lit((1 << rest) - 1))
    return key.bitwiseAND(F.lit(-(1 << rest))).bitwiseOR(moved)


def links(fingerprints: DataFrame, split: int = SPLIT) -> DataFrame:
    """fingerprints: column fp (long, distinct). Returns edges (u, v) that connect just what links within the budget connect.

    Every fingerprint goes to one bucket for each of its blocks, rotated to the front. A bucket of more than `split` keys is dealt
    again: its keys' other 48 bits have four parts, of which two keys within the budget share one, so each key goes to
    four finer buckets instead. A task walks the tries of its buckets and returns a spanning star of each component found there,
    so n linked fingerprints give fewer than n edges a bucketing.
    """
    bucket = lambda key: F.shiftrightunsigned(key, 64 - BITS).cast("int")
    blocks = F.array(*(F.struct(F.lit(r).alias("r"), _turned(F.col("fp"), r).alias("key")) for r in range(BLOCKS)))
    dealt = fingerprints.select("fp", F.explode(blocks).alias("t")).select("fp", "t.r", "t.key").withColumn("bucket", bucket(F.col("key")))
    # At most BLOCKS * 2 ** BITS rows, whatever the input, so this may be broadcast.
    hot = durable(dealt.groupBy("r", "bucket").count().filter(F.col("count") > split).select("r", "bucket", F.lit(True).alias("hot")))
    dealt = dealt.join(F.broadcast(hot), ["r", "bucket"], "left")
    once = F.array(F.struct(F.lit(-1).alias("q"), F.col("key").alias("key"), F.col("bucket").cast("long").alias("bucket")))
    finer = []
    for q in range(SUB_PARTS):
        key = _subturned(F.col("key"), q)
        finer.append(F.struct(F.lit(q).alias("q"), key.alias("key"), F.shiftrightunsigned(key, 64 - BITS - SUB_BITS).alias("bucket")))
    dealt = dealt.select("fp", "r", F.explode(F.when(F.col("hot"), F.array(*finer)).otherwise(once)).alias("t")).select("fp", "r", "t.*")
    unsigned = F.col("key").bitwiseXOR(F.lit(-(2**63)))
    dealt = dealt.repartition("r", "q", "bucket").sortWithinPartitions("r", "q", "bucket", unsigned)

    def read(b):
        turn = b.column("r").to_numpy().astype(np.int64) * (SUB_PARTS + 1) + b.column("q").to_numpy() + 1
        return turn, b.column("bucket").to_numpy(), b.column("key").to_numpy().view(np.uint64), b.column("fp").to_numpy()

    def join(batches):
        for turn, starts, key, fp in whole_buckets(batches, read):
            depth = BITS if turn % (SUB_PARTS + 1) == 0 else BITS + SUB_BITS
            yield from _stars(trie_components(key, starts, depth), fp)

    return dealt.select("r", "q", "bucket", "key", "fp").mapInArrow(join, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), any direction -> (node, root): every node's least reachable node, for nodes other than roots.

    Alternates large-star and small-star rounds; each is joins and aggregates, and its result is checkpointed.
    """
    e = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = durable(small.select("x.*").filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def clusters(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp) -> (fp, component_id) for every distinct fp; component_id: the least doc_id of its component."""
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(nodes.select("fp")))
    rooted = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for every row of docs.

    Rows link when their fingerprints differ in 3 bits at most; component_id is the least doc_id reachable over links.
    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id take part; a component of
    such rows only has a null component_id. Repeated rows come back as often as they stand. No documents: no rows.
    """
    prints = durable(with_fingerprints(docs.select("doc_id", "text")))
    out = prints.join(durable(clusters(prints)), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(words: list[bytes], ids, hasher: Hasher, shingle: int) -> np.ndarray:
    """WORDS_WIDE times 64 bits by the same rule from shingles of words, repeats included: each shingle's hash is mixed anew for each word."""
    if not words:
        return np.zeros(WORDS_WIDE, np.uint64)
    tokens = np.fromiter((ids[w] for w in words), np.uint64, len(words))
    h = hasher.windows(hasher.running(tokens), min(shingle, len(words)))
    ones, n = np.zeros(64 * WORDS_WIDE, np.int64), len(h)
    for k in range(0, n, 4096):
        spread = mix64(h[k : k + 4096, None] + _WIDE_SEEDS[None, :])
        ones += np.unpackbits(spread.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).view(np.uint64)


def with_wide_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """docs without text, plus `wide`: the wide fingerprint of each row's whole text (binary)."""
    schema = docs.drop("text", "wide").schema.add("wide", "binary")

    def add(batches):
        ids, hasher = token_hashes(), Hasher()
        for b in batches:
            wide = [wide_fingerprint(words_of(t.lower() if t else t), ids, hasher, shingle).tobytes() for t in byte_column(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in schema.names[:-1]), pa.array(wide, pa.binary())], names=schema.names)

    return docs.mapInArrow(add, schema)


def wide_links(nodes: DataFrame, budget: int) -> DataFrame:
    """nodes (node, wide), distinct. Edges (u, v) between fingerprints of which one of the blocks is equal and at most `budget` bits differ.

    Every fingerprint goes to a bucket for each of its blocks; tasks walk the tries of their buckets by the block's 64-bit word with a
    budget for that word and hold what is left against the whole fingerprint."""

    def deal(batches):
        for b in batches:
            node = b.column("node").to_numpy()
            wide = np.frombuffer(b"".join(b.column("wide").to_pylist()), np.uint64).reshape(-1, WORDS_WIDE)
            for r in range(BLOCKS * WORDS_WIDE):
                word, turn = wide[:, r // BLOCKS], np.uint64(r % BLOCKS * BITS)
                key = (word << turn) | (word >> (np.uint64(64) - turn)) if turn else word
                bucket = (key >> np.uint64(64 - BITS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), r, np.int32)), pa.array(bucket), pa.array((key ^ np.uint64(1 << 63)).view(np.int64)), pa.array(node), b.column("wide")], names=["r", "bucket", "key", "node", "wide"])

    dealt = nodes.select("node", "wide").mapInArrow(deal, "r int, bucket int, key long, node long, wide binary")
    dealt = dealt.repartition("r", "bucket").sortWithinPartitions("r", "bucket", "key", "node")

    def read(b):
        wide = np.frombuffer(b"".join(b.column("wide").to_pylist()), np.uint64).reshape(-1, WORDS_WIDE)
        key = b.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        return b.column("r").to_numpy(), b.column("bucket").to_numpy(), key, b.column("node").to_numpy(), wide

    def join(batches):
        for _, starts, key, node, wide in whole_buckets(batches, read):

            def verify(i, j):
                right = np.zeros(len(i), bool)
                for k in range(0, len(i), CHUNK):
                    right[k : k + CHUNK] = np.bitwise_count(wide[i[k : k + CHUNK]] ^ wide[j[k : k + CHUNK]]).sum(axis=1) <= budget
                return right

            yield from _stars(trie_components(key, starts, BITS, WORD_BUDGET, verify), node)

    return dealt.mapInArrow(join, "u long, v long")


def keep_one(docs: DataFrame, shingle: int = WIDE_SHINGLE, budget: int = WIDE_BUDGET) -> DataFrame:
    """One row of docs for each group of near-duplicates, the one with the least doc_id; docs' columns.

    Near-duplicates are texts whose shingles of five words (lower-cased; a shorter text is one shingle) have a Jaccard similarity of
    about 0.8 or more, as 512-bit fingerprints tell: two sets of similarity J differ in acos(2J / (1 + J)) / pi of the bits, which is
    0.15 at 0.8; groups are what links connect. Null and empty texts are near-duplicates of each other. Among rows of a group that share
    its least doc_id one is kept, the one with the least text hash; a doc_id that stands in several groups keeps a row in each. Rows with a null doc_id rank behind all others, by their text.
    Repeated rows are copies of each other. No documents: no rows.
    """
    own = F.xxhash64("text")
    rank = F.coalesce("doc_id", F.shiftrightunsigned(own, 1).bitwiseOR(F.lit(1 << 62)))
    ranked = durable(with_wide_fingerprints(docs.select("text", rank.alias("_rank"), own.alias("_own")), shingle).withColumn("node", F.xxhash64("wide")))
    nodes = ranked.groupBy("node").agg(F.first("wide").alias("wide"), F.min("_rank").alias("least"))
    nodes = durable(nodes)
    linked = components(wide_links(nodes, budget)).withColumnsRenamed({"node": "_node", "root": "_root"})
    rooted = nodes.select("node", "least").join(linked, F.col("node") == F.col("_node"), "left").select(F.coalesce("_root", "node").alias("root"), "node", "least")
    chosen = rooted.groupBy("root").agg(F.min_by(F.struct("node", "least"), "least").alias("c")).select("c.*")
    # Only a group's least row can be kept, so the rest of ranked goes before rows are compared.
    kept = ranked.join(chosen, "node").filter(F.col("_rank") == F.col("least")).groupBy("node", "_rank").agg(F.min("_own").alias("_own"))
    lean, restored = set_aside(docs, "doc_id", "text")
    picked = lean.withColumns({"_rank": rank, "_own": own}).join(kept, ["_rank", "_own"], "left_semi")
    return picked.dropDuplicates(["_rank", "_own"]).select(*restored)
