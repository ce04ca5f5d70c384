"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.llm.common import Memo, batches_of, byte_column, durable, words_of

#: Rows of the word table (words share a row by hash), size of a word vector, size of an ending's vector.
ROWS, SIZE, ENDING_ROWS, ENDING_SIZE = 1 << 14, 16, 1 << 12, 24
#: The network is fitted on at most so many labelled documents, those with the least hash of their doc_id.
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, SEED = 32, 40, 11
THRESHOLD = 0.3


def _signs(rows: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 0, 1], np.int32), (rows, size), p=[0.25, 0.5, 0.25])


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Fixed random ternary index vectors of word rows and of word endings."""
    return _signs(ROWS, SIZE, SEED), _signs(ENDING_ROWS, ENDING_SIZE, SEED + 1)


def _rows_of_word(word: bytes) -> int:
    return (zlib.crc32(word) % ROWS) * ENDING_ROWS + zlib.crc32(word[-2:], 7) % ENDING_ROWS


def _coded(texts: list, memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows and ending rows of several texts end to end, and the number of words in each text."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    get = memo.__getitem__
    codes = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(sizes.sum()))
    return codes // ENDING_ROWS, codes % ENDING_ROWS, sizes


def _inner(sizes: np.ndarray) -> np.ndarray:
    """For tokens of several texts end to end: whether the next token is in the same text."""
    inner = np.ones(int(sizes.sum()), bool)
    ends = np.cumsum(sizes)[sizes > 0] - 1
    inner[ends] = False
    return inner


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors (ROWS x SIZE): for each word row the index vectors of all its neighbours, summed over all documents.

    Every task sends one row of integers for each word row it met, so sums don't depend on order; the result has a fixed size.
    """
    names = [f"v{k}" for k in range(SIZE)]

    def gather(batches):
        index, _ = _index_vectors()
        memo, total, seen = Memo(_rows_of_word), np.zeros((ROWS, SIZE), np.int64), np.zeros(ROWS, np.int64)
        for b in batches:
            texts = byte_column(b.column(0))
            for lo, hi in batches_of(texts):
                rows, _, sizes = _coded(texts[lo:hi], memo)
                if not len(rows):
                    continue
                inner = np.flatnonzero(_inner(sizes)[:-1])
                near = np.zeros((len(rows), SIZE), np.int32)
                near[inner] += index[rows[inner + 1]]
                near[inner + 1] += index[rows[inner]]
                seen += np.bincount(rows, minlength=ROWS)
                for k in range(SIZE):
                    total[:, k] += np.bincount(rows, weights=near[:, k], minlength=ROWS).astype(np.int64)
        met = np.flatnonzero(seen)
        columns = {"row": met.astype(np.int32), **{n: total[met, k] for k, n in enumerate(names)}}
        yield pa.RecordBatch.from_pydict(columns)

    parts = docs.select("text").mapInArrow(gather, "row int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((ROWS, SIZE))
    for r in parts.groupBy("row").agg(*(F.sum(n) for n in names)).toLocalIterator():
        out[r[0]] = r[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, x: for each document the mean and spread of its word vectors, the mean and spread of its endings' vectors,
    the mean likeness of neighbouring words and the log of its length."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        _, endings = _index_vectors()
        table, memo = shared.value, Memo(_rows_of_word)
        for b in batches:
            texts, out = byte_column(b.column("text")), []
            for lo, hi in batches_of(texts):
                rows, ends, sizes = _coded(texts[lo:hi], memo)
                some = np.flatnonzero(sizes)
                x = np.zeros((hi - lo, 2 * SIZE + 2 * ENDING_SIZE + 2), np.float32)
                if len(some):
                    starts, n = (np.cumsum(sizes) - sizes)[some], sizes[some][:, None]
                    at = 0
                    for v in (table[rows], endings[ends].astype(np.float32)):
                        mean = np.add.reduceat(v, starts, axis=0) / n
                        square = np.add.reduceat(v * v, starts, axis=0) / n
                        width = v.shape[1]
                        x[some, at : at + width] = mean
                        x[some, at + width : at + 2 * width] = np.sqrt(np.maximum(square - mean * mean, 0))
                        at += 2 * width
                        if width == SIZE:
                            alike = np.zeros(len(rows), np.float32)
                            inner = np.flatnonzero(_inner(sizes)[:-1])
                            alike[inner] = np.einsum("ij,ij->i", v[inner], v[inner + 1])
                            x[some, -2] = np.add.reduceat(alike, starts) / n[:, 0]
                    x[some, -1] = np.log(n[:, 0])
                out.append(x)
            flat = np.concatenate(out).ravel() if out else np.zeros(0, np.float32)
            size = 2 * SIZE + 2 * ENDING_SIZE + 2
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), size).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(pool, "doc_id long, x array<float>")


class Network:
    """One hidden layer; inputs are standardised, the output's logit is divided by a temperature fitted on held-back rows."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        order = rng.permutation(len(x))
        back, own = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - self.mean) / self.scale
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step = [0 * p for p in self.p], [0 * p for p in self.p], 0
        for epoch in range(EPOCHS):
            rng.shuffle(own)
            for k in range(0, len(own), 256):
                i = own[k : k + 256]
                h = np.maximum(z[i] @ self.p[0] + self.p[1], 0)
                e = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[i]) / len(i)
                back_h = np.outer(e, self.p[2]) * (h > 0)
                grads = [z[i].T @ back_h + 1e-5 * self.p[0], back_h.sum(axis=0), h.T @ e, np.array([e.sum()])]
                step += 1
                for j, g in enumerate(grads):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    self.p[j] = self.p[j] - 0.003 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(back) and 0 < y[back].mean() < 1:
            logit = self.logit(x[back])
            loss = lambda t: np.logaddexp(0, np.where(y[back] > 0, -logit, logit) / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 60), key=loss)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.p[0] + self.p[1], 0)
        return h @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id's text modulo folds; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; its other columns are not read.

    Word vectors come from all texts. The network learns labels.quality from documents outside fold 0 only, at most
    max_labelled of them. Null and empty texts pool to zeros and get that point's score. Rows with a null doc_id are scored and are
    not held out; null labels are skipped; a doc_id labelled twice counts twice; repeated rows get equal scores. With no usable label every score is 0.5.
    """
    x = durable(pooled(docs, word_vectors(docs)))
    usable = labels.select("doc_id", "quality").filter("quality is not null").filter(fold_of(F.col("doc_id")) != 0)
    usable = durable(usable.join(x.select("doc_id"), "doc_id", "left_semi"))
    # A cut on a hash of doc_id leaves little more than max_labelled of the labels that have a document before the exact limit is taken.
    share = min(1.0, 1.2 * max_labelled / max(usable.count(), 1))
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    known = x.join(usable.filter(ticket < F.lit(int(share * (1 << 32)))), "doc_id").orderBy(ticket, "doc_id", "quality", "x").limit(max_labelled)
    rows = known.select("x", "quality").collect()
    model = None
    if rows:
        model = Network().fit(np.array([r[0] for r in rows], np.float64), np.array([r[1] for r in rows], np.float64))

    def apply(batches):
        for b in batches:
            v = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            score = np.full(b.num_rows, 0.5) if model is None else model.score(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = x.mapInArrow(apply, "doc_id long, score double")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
