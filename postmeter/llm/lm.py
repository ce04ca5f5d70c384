"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(cell | class, history) * P(word | cell). The first two factors are softmaxes over CLASSES
classes and over the CELLS cells of a class, with hashed features of the history (the word before, the word before that, skipping
one, and both); the third is the word's smoothed share of its cell. The commonest words have a cell of their own, all others are
put by their endings and beginnings. Every other cell keeps one place for words never seen, so the probabilities of all words sum to one.

Training runs in rounds. Each round takes a fixed share of the documents, by a hash; tasks sum the gradient at the round's weights in
whole units, so the sum is the same however documents are dealt over tasks, and one step is taken with it.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.llm.common import batches_of, byte_column, durable, mix64, words_of

#: Classes of the commonest words, each with a cell of its own; classes of other words; cells of a class; hash rows of each feature.
OWN_CLASSES, OTHER_CLASSES, CELLS, HASHED, FEATURES = 8, 8, 16, 1 << 13, 3
CLASSES = OWN_CLASSES + OTHER_CLASSES
#: Words whose cell is their own.
OWN = OWN_CLASSES * CELLS
#: Most words whose counts are broadcast: those that make up more than one in FREQUENT of all tokens.
FREQUENT = 1 << 19
#: Distinct words that a worker knows (and a task counts) before it starts anew, and tokens looked at together.
KNOWN, STEP_TOKENS = 800_000, 32_768
#: Rounds of training; how far one step may move a weight, its length, and the count that steadies rare rows.
ROUNDS, MOST_STEP, RATE, STEADY = 4, 2.0, 0.8, 4.0
#: Gradients are summed as whole multiples of this, so that sums don't depend on order.
UNIT = 2.0**-16
#: Partitions of documents that one training task takes together: each task sends a gradient of fixed size.
TOGETHER = 4
HELD_OUT_FOLD, FOLDS = 2, 7


def _id(word: bytes) -> int:
    """57 bits of a word's hash and, in the last seven, the class of its ending and the cell of its beginning."""
    return (xxhash.xxh64_intdigest(word) & ~0x7F) | (zlib.crc32(word[-2:]) & 0x7) << 4 | (zlib.crc32(word[:2]) & 0xF)


#: The id of a text's end, which no word can have as words are never empty.
END = _id(b"")


class Words(dict):
    """A worker's numbers of the words that it has met, and what it knows of each by number; number 0 is a text's end.

    look_up, if given, tells cell, training count and whether it is frequent for an array of ids; it is asked once for a word."""

    def __init__(self, look_up=None, most: int = KNOWN):
        super().__init__()
        self.look_up, self.most = look_up, most
        self.start()

    def start(self) -> None:
        self.clear()
        self.ids = self.one = self.two = np.zeros(0, np.uint64)
        self.cell, self.n, self.hit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.fresh = [END]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        self.fresh.append(_id(word))
        return number

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of several texts end to end, an end after each text, and the number of tokens in each. Numbers hold until the next call."""
        if len(self) > self.most:
            self.start()
        words = [words_of(t.lower() if t else t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        tokens, inner = np.zeros(int(sizes.sum()), np.int32), np.ones(int(sizes.sum()), bool)
        inner[np.cumsum(sizes) - 1] = False
        tokens[inner] = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int32, len(tokens) - len(texts))
        if self.fresh:
            ids = np.array(self.fresh, np.uint64)
            self.ids, self.one, self.two = np.append(self.ids, ids), np.append(self.one, mix64(ids)), np.append(self.two, mix64(ids + np.uint64(1)))
            if self.look_up:
                cell, n, hit = self.look_up(ids)
                self.cell, self.n, self.hit = np.append(self.cell, cell), np.append(self.n, n), np.append(self.hit, hit)
            self.fresh = []
        return tokens, sizes

    def histories(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes (3 x tokens) of the features of each token's history; texts begin with ends as their history."""
        one, two = np.zeros_like(tokens), np.zeros_like(tokens)
        one[1:], two[2:] = tokens[:-1], tokens[:-2]
        starts = np.cumsum(sizes) - sizes
        one[starts] = two[starts] = 0
        two[starts[sizes > 1] + 1] = 0
        return np.stack([self.one[one], self.two[two], mix64(self.ids[one] * np.uint64(3) + self.one[two])])


#: A worker's words by what they are for: they outlive a task.
_WORKER: dict[str, Words] = {}


def _worker_words(purpose: str, look_up=None) -> Words:
    if purpose not in _WORKER:
        _WORKER.clear()
        _WORKER[purpose] = Words(look_up)
    return _WORKER[purpose]


def in_training(doc_id: Column) -> Column:
    """Whether a document trains the model; one with a null doc_id does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != HELD_OUT_FOLD, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text, train) -> (id, n, total): each word's count in training documents and in all documents."""

    def count(batches):
        words, train, total = _worker_words("counts"), np.zeros(0), np.zeros(0, np.int64)

        def rows():
            met = np.flatnonzero(total)
            return pa.RecordBatch.from_pydict({"id": words.ids[met].view(np.int64), "n": train[met].astype(np.int64), "total": total[met]})

        for b in batches:
            texts, trains = byte_column(b.column("text")), b.column("train").to_numpy(zero_copy_only=False).astype(np.float64)
            for lo, hi in batches_of(texts):
                if len(words) > words.most:
                    yield rows()
                    train, total = np.zeros(0), np.zeros(0, np.int64)
                tokens, sizes = words.encode(texts[lo:hi])
                grown = len(words.ids) - len(total)
                train, total = np.append(train, np.zeros(grown)), np.append(total, np.zeros(grown, np.int64))
                train += np.bincount(tokens, np.repeat(trains[lo:hi], sizes), len(total))
                total += np.bincount(tokens, minlength=len(total))
        yield rows()

    parts = docs.select("text", "train").mapInArrow(count, "id long, n long, total long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class Vocabulary:
    """What every task knows of the counts: totals, the frequent words, and each class' size. Bounded by FREQUENT."""

    def __init__(self, counts: DataFrame):
        self.name = uuid.uuid4().hex
        row = counts.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1)), F.sum("total")).first()
        self.tokens, self.distinct = row[0] or 0, row[1] or 0
        floor = (row[2] or 0) / FREQUENT
        known = counts.filter(F.col("total") > floor).select("id", "n").toArrow()
        table = np.stack([known.column(c).to_numpy() for c in ("id", "n")], axis=1)
        order = np.argsort(table[:, 0].view(np.uint64) if len(table) else table[:, 0])
        self.ids, self.n = np.ascontiguousarray(table[order, 0]).view(np.uint64), np.ascontiguousarray(table[order, 1])
        top = np.lexsort((self.ids, -self.n))[:OWN]
        self.own = np.full(len(self.ids), -1)
        self.own[top] = np.arange(len(top))
        cell = F.col("id").bitwiseAND(F.lit(0x7F))
        size, kinds = np.zeros(CLASSES * CELLS), np.zeros(CLASSES * CELLS)
        for c, n, v in counts.filter("n > 0").groupBy(cell.alias("c")).agg(F.sum("n"), F.count("*")).collect():
            size[OWN + c], kinds[OWN + c] = n, v
        for k, at in enumerate(top):
            if self.n[at] > 0:
                c = OWN + int(self.ids[at] & np.uint64(0x7F))
                size[c], kinds[c], size[k], kinds[k] = size[c] - self.n[at], kinds[c] - 1, self.n[at], 1
        # A cell of one's own has no place for unseen words, as only its word can be in it.
        self.room = size + kinds + (np.arange(len(size)) >= OWN)
        self.room[self.room == 0] = 1
        share = (size + 1.0).reshape(CLASSES, CELLS)
        whole = share.sum(axis=1)
        self.class_share, self.cell_share = whole / whole.sum(), share / whole[:, None]
        self.class_prior, self.cell_prior = np.log(self.class_share).astype(np.float32), np.log(self.cell_share).astype(np.float32)

    def look_up(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its cell, its training count (0 if not frequent) and whether it is frequent."""
        cell = OWN + (ids & np.uint64(0x7F)).astype(np.int64)
        if not len(self.ids):
            return cell, np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        u, back = np.unique(ids, return_inverse=True)
        at = np.minimum(np.searchsorted(self.ids, u), len(self.ids) - 1)
        hit = self.ids[at] == u
        own = np.where(hit, self.own[at], -1)[back]
        return np.where(own >= 0, own, cell), np.where(hit, self.n[at], 0)[back], hit[back]


def _rows(hashes: np.ndarray) -> np.ndarray:
    """Weight rows of the first softmax: a block of HASHED for each feature."""
    return (hashes & np.uint64(HASHED - 1)).astype(np.int64) + (np.arange(FEATURES) * HASHED)[:, None]


def _cell_rows(hashes: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Weight rows of the second softmax, which depend on the class too and follow those of the first."""
    spread = (hashes >> np.uint64(20)) + cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    return _rows(spread) + FEATURES * HASHED


def _logits(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of three rows of weights and the prior. Training bounds a weight by ROUNDS steps, so their exponentials need no shift."""
    z = weights[rows[0]]
    z += weights[rows[1]]
    z += weights[rows[2]]
    z += prior
    return z


def _log_softmax_of(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log probability of one chosen column of each row."""
    picked = z[np.arange(len(chosen)), chosen]
    return picked - np.log(np.exp(z, out=z).sum(axis=1))


def round_of(doc_id: Column, text: Column) -> Column:
    """The round that a document trains in."""
    return F.pmod(F.xxhash64(F.lit("round"), doc_id, text), F.lit(ROUNDS))


def gradient(docs: DataFrame, vocabulary, weights) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the training texts' log probability (rows x CELLS, of both softmaxes), and how often each row was met."""
    names = [f"g{k}" for k in range(CELLS)]

    def summed(batches):
        v, w = vocabulary.value, weights.value
        words = _worker_words(v.name, v.look_up)
        total, met = np.zeros((CELLS, len(w))), np.zeros(len(w), np.int64)  # whole numbers, below 2**53

        def add(rows, prior, right):
            slope = _logits(w, prior, rows)
            np.exp(slope, out=slope)
            slope *= np.float32(-1 / UNIT) / slope.sum(axis=1, keepdims=True)
            slope[np.arange(len(right)), right] += np.float32(1 / UNIT)
            by_cell = np.rint(slope, out=slope).T.astype(np.float64, order="C")
            for r in rows:
                block = slice(at := int(r[0]) // HASHED * HASHED, at + HASHED)
                r = r - at
                met[block] += np.bincount(r, minlength=HASHED)
                for k in range(CELLS):
                    total[k, block] += np.bincount(r, by_cell[k], HASHED)

        for b in batches:
            texts = byte_column(b.column("text"))
            for lo, hi in batches_of(texts):
                tokens, sizes = words.encode(texts[lo:hi])
                h, cell = words.histories(tokens, sizes), words.cell[tokens]
                for k in range(0, len(tokens), STEP_TOKENS):
                    part, c = h[:, k : k + STEP_TOKENS], cell[k : k + STEP_TOKENS]
                    add(_rows(part), v.class_prior, c // CELLS)
                    add(_cell_rows(part, c // CELLS), v.cell_prior[c // CELLS], c % CELLS)
        rows = np.flatnonzero(met)
        yield pa.RecordBatch.from_pydict({"row": rows.astype(np.int32), "n": met[rows], **{x: total[k, rows].astype(np.int64) for k, x in enumerate(names)}})

    parts = docs.mapInArrow(summed, "row int, n long, " + ", ".join(f"{x} long" for x in names))
    got = parts.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names)).toArrow()
    slope, met = np.zeros((2 * FEATURES * HASHED, CELLS)), np.zeros(2 * FEATURES * HASHED)
    row = got.column("row").to_numpy()
    met[row] = got.column("n").to_numpy()
    for k, x in enumerate(names):
        slope[row, k] = got.column(x).to_numpy() * UNIT
    return slope, met


def train(docs: DataFrame, vocabulary) -> np.ndarray:
    """Weights of both softmaxes (2 * FEATURES * HASHED x CELLS): ROUNDS steps, each with the gradient over one share of the documents.

    A step divides a row's gradient by how often the class was to be expected in it, the diagonal of the curvature; the features of
    one token share it. What travels is a gradient of fixed size for each task."""
    sc = docs.sparkSession.sparkContext
    v = vocabulary.value
    w = np.zeros((2 * FEATURES * HASHED, CELLS), np.float32)
    # A row of the second softmax may serve several classes; it expects what an even mix of cells would give.
    expected = np.concatenate([np.tile(v.class_share, (FEATURES * HASHED, 1)), np.full((FEATURES * HASHED, CELLS), 1 / CELLS)])
    own = docs.filter("train").withColumn("round", round_of(F.col("doc_id"), F.col("text")))
    tasks = max(sc.defaultParallelism, own.rdd.getNumPartitions() // TOGETHER)
    for k in range(ROUNDS):
        shared = sc.broadcast(w)
        slope, met = gradient(own.filter(F.col("round") == k).select("text").coalesce(tasks), vocabulary, shared)
        step = np.clip(slope / (met[:, None] * expected + STEADY), -MOST_STEP, MOST_STEP)
        w = (w + RATE * step).astype(np.float32)
        shared.unpersist()
    return w


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    base_score: log10 probability of the text's tokens (its words and one end) by add-one counts of the training documents; score: by the model.
    Columns of docs other than doc_id and text are not read. Null and empty texts are one end. A null doc_id counts as training. Repeated rows get equal scores, and count as often as they
    stand. Without training documents every token has count 0. No documents: no rows.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text", in_training(F.col("doc_id")).alias("train"))
    counts = durable(word_counts(docs))
    vocabulary = sc.broadcast(Vocabulary(counts))
    weights = sc.broadcast(train(docs, vocabulary))
    tokens, distinct = vocabulary.value.tokens, vocabulary.value.distinct

    def apply(batches):
        v, w = vocabulary.value, weights.value
        words, room = _worker_words(v.name, v.look_up), np.log10(v.room)
        for b in batches:
            texts = byte_column(b.column("text"))
            for lo, hi in batches_of(texts):
                tokens, sizes = words.encode(texts[lo:hi])
                h, cell, n, hit = words.histories(tokens, sizes), words.cell[tokens], words.n[tokens], words.hit[tokens]
                part = np.empty(len(tokens))
                for k in range(0, len(tokens), STEP_TOKENS):
                    some, c = h[:, k : k + STEP_TOKENS], cell[k : k + STEP_TOKENS]
                    cls = c // CELLS
                    part[k : k + STEP_TOKENS] = _log_softmax_of(_logits(w, v.class_prior, _rows(some)), cls)
                    part[k : k + STEP_TOKENS] += _log_softmax_of(_logits(w, v.cell_prior[cls], _cell_rows(some, cls)), c % CELLS)
                part = part / np.log(10) - room[cell]
                starts = np.cumsum(sizes) - sizes
                own = [xxhash.xxh64_intdigest(t or b"") - (1 << 63) for t in texts[lo:hi]]
                doc = b.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc,
                        pa.array(own, pa.int64()),
                        pa.nulls(hi - lo, pa.int64()),
                        pa.array(np.ones(hi - lo, np.int64)),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((hit & (n > 0)).astype(np.int64), starts)),
                        pa.array(np.add.reduceat(part, starts)),
                        pa.array(np.add.reduceat(np.log10(n + 1.0), starts)),
                    ],
                    names=COLUMNS,
                )
                missed = np.flatnonzero(~hit)
                row = np.repeat(np.arange(hi - lo), sizes)[missed]
                pairs, times = np.unique(row * len(words.ids) + tokens[missed], return_counts=True)
                row, word = pairs // len(words.ids), words.ids[pairs % len(words.ids)]
                zero = np.zeros(len(row))
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(row)), pa.array(np.array(own, np.int64)[row]), pa.array(word.view(np.int64)), pa.array(times.astype(np.int64)), *(pa.array(zero.astype(t)) for t in (np.int64, np.int64, float, float))],
                    names=COLUMNS,
                )

    COLUMNS = ["doc_id", "own", "id", "times", "n_tokens", "n_known", "part", "seen"]
    found = docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, own long, id long, times long, n_tokens long, n_known long, part double, seen double")
    # Document rows have no id; a stand-in spreads them over the join's partitions and meets no count.
    spread = F.coalesce("id", F.col("own"))
    rare = counts.select(F.col("id").alias("_id"), "n").withColumn("is_word", F.lit(True))
    joined = found.withColumn("_id", spread).join(rare, "_id", "left")
    word = F.col("id").isNotNull()
    n = F.coalesce("n", F.lit(0))
    sums = joined.groupBy("doc_id", "own").agg(
        F.sum(F.when(~word, F.col("times"))).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(word & (n > 0), F.col("times")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum("part").alias("part"),
        F.sum(F.when(word, F.col("times") * F.log10(n + F.lit(1.0))).otherwise(F.col("seen"))).alias("seen"),
    )
    # Repeated rows were summed together: each gets its share.
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", *((F.col(c) / F.col("copies")).alias(c) for c in ("n_tokens", "n_known", "part", "seen")))
    whole = lambda c: F.round(c).cast("long").alias(c)
    base = F.col("seen") - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))
    return each.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), whole("n_tokens"), whole("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("part") + F.col("seen")).alias("score"))
