"""The quality classifier against a plain rendering: vectors, pooling, the rows it may learn from, scores and contract columns."""

import math
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from postmeter.llm import classifier as c


def plain_vectors(texts):
    index, _ = c._index_vectors()
    out = np.zeros((c.ROWS, c.SIZE))
    for t in texts:
        rows = [zlib.crc32(w) % c.ROWS for w in (t or "").encode().split()]
        for a, b in zip(rows, rows[1:]):
            out[a] += index[b]
            out[b] += index[a]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def plain_pooled(text, vectors):
    _, endings = c._index_vectors()
    words = (text or "").encode().split()
    if not words:
        return np.zeros(2 * c.SIZE + 2 * c.ENDING_SIZE + 2)
    v = np.array([vectors[zlib.crc32(w) % c.ROWS] for w in words], np.float64)
    e = np.array([endings[zlib.crc32(w[-2:], 7) % c.ENDING_ROWS] for w in words], np.float64)
    alike = sum(float(a @ b) for a, b in zip(v, v[1:])) / len(words)
    return np.concatenate([v.mean(0), v.std(0), e.mean(0), e.std(0), [alike, math.log(len(words))]])


@pytest.mark.parametrize("labelled", [40, 0])
def test_scores(spark, docs, rows, labelled):
    labels = [(i, (i * 7) % 3 == 0, 0) for i in range(labelled)] + [(3, None, 0), (None, 1, 0), (10_000, 1, 0)]
    table = spark.createDataFrame([(i, None if q is None else int(q), t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    vectors = plain_vectors([r[1] for r in rows])
    x = {k: plain_pooled(r[1], vectors) for k, r in enumerate(rows)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ticket = lambda i: xxhash.xxh64_intdigest(struct.pack("<q", i), 42) % (1 << 32)
    usable = [(i, int(q)) for i, q, _ in labels if i is not None and q is not None and fold(i) != 0]
    known = sorted((ticket(i), i, q, tuple(np.float32(x[k]))) for i, q in usable for k, r in enumerate(rows) if r[0] == i)
    model = c.Network().fit(np.array([k[3] for k in known], np.float64), np.array([k[2] for k in known], np.float64)) if known else None
    want = defaultdict(list)
    for k, r in enumerate(rows):
        want[r[0]].append(0.5 if model is None else float(model.score(np.float32(x[k])[None, :])[0]))
    got = defaultdict(list)
    for r in c.score_quality(docs, table).collect():
        got[r.doc_id].append(r.score)
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    assert got.keys() == want.keys() and all(np.allclose(sorted(got[i]), sorted(want[i]), atol=2e-3) for i in want)
