"""Clustering, fill-in-middle and piece codes against plain renderings of their contracts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmeter.llm import clustering, fim, pieces
from postmeter.llm.common import Memo


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_clusters(vectors, k, rounds, dims, salt="3:"):
    """Rounds over all vectors in whole numbers."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, sha(f"{salt}{r[0]}")), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    for n in range(rounds + 1):
        squares = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        own = [min(range(len(centroids)), key=lambda j: (s[j], j)) for s in squares]
        if n < rounds:
            for j in range(len(centroids)):
                members = [v for (_, v), o in zip(kept, own) if o == j]
                if members:
                    centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    distance = [s[o] for s, o in zip(squares, own)]
    inertia = Counter()
    for o, d in zip(own, distance):
        inertia[o] += d
    return Counter((i, o, d, inertia[o], sum(distance), sha(",".join(map(str, centroids[o])))) for (i, _), o, d in zip(kept, own, distance))


VECTORS = "vec_id long, embedding array<double>, cluster string, x int"


def odd_vectors(rng, n, dims):
    out = [(i, [rng.gauss(3 * (i % 3), 1) for _ in range(dims)], "a", 1) for i in range(n)]
    out += [(n + i, [float(i % 2)] * dims, None, None) for i in range(9)]  # many ties and copies
    out += [(None, [0.25] * dims, "b", 2), (3, out[3][1], "c", 3), (n + 20, None, "", 0), (n + 21, [1.0] * (dims - 1), "", 0), (n + 22, [None] + [1.0] * (dims - 1), "", 0), (n + 23, [float("nan")] * dims, "", 0), (n + 24, [float("inf")] * dims, "", 0), (n + 25, [], "", 0), (n + 26, [1e9] * dims, "too large", 0)]
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_clusters(spark, k):
    rows = odd_vectors(random.Random(k), 80, 5)
    got = Counter(map(tuple, clustering.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k=k, rounds=3, dims=5).collect()))
    assert got == plain_clusters([r[:2] for r in rows if r[2] != "too large"], k, 3, 5)


def test_clusters_of_few_vectors(spark):
    few = spark.createDataFrame([(1, [0.5, 0.5], "", 0), (2, [0.5, 0.5], "", 0)], VECTORS)
    got = clustering.cluster(few, k=8, rounds=2, dims=2).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in sorted(got)] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert clustering.cluster(few.limit(0), dims=2).collect() == []


def test_heaps_hold_and_spare_work():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 7, 100, 1000):
        gaps = rng.integers(0, 50, n).astype(float)
        heap = gaps[clustering.heap_order(gaps)]
        assert sorted(heap) == sorted(gaps) and all(heap[(i - 1) // 2] <= heap[i] for i in range(1, n))
        assert sorted(clustering.expired(heap, 9)) == np.flatnonzero(heap <= 9).tolist()
    # far groups: after the first rounds no gap runs out, and the result stays that of a full comparison
    x = np.concatenate([rng.integers(0, 50, (300, 4)) + at for at in (0, 5000, 20000)]).astype(np.int32)
    centroids, heaps, offsets = np.array([[0] * 4, [4000] * 4, [15000] * 4], np.int64), None, np.zeros(3)
    popped = []
    for _ in range(5):
        popped.append(len(x) if heaps is None else len(clustering.Heaps(list(heaps.rows), list(heaps.gaps)).pop(offsets * (1 + clustering.SLACK))[0]))
        heaps, _ = clustering.advance(heaps, x, centroids, offsets)
        assert (heaps.clusters() == clustering.squared_distances(x, centroids).argmin(axis=1)).all()
        moved = np.array([x[heaps.clusters() == j].astype(np.int64).sum(axis=0) // max(1, (heaps.clusters() == j).sum()) for j in range(3)])
        drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1))
        offsets, centroids = offsets + drift + np.array([np.delete(drift, j).max() for j in range(3)]), moved
    assert popped[0] == 900 and popped[-1] == 0


def test_random_rounds_equal_full_comparisons():
    rng = np.random.default_rng(9)
    x = rng.integers(-3000, 3000, (2000, 6)).astype(np.int32)
    centroids, heaps, offsets = x[:5].astype(np.int64), None, np.zeros(5)
    total = np.zeros((5, 7), np.int64)
    for _ in range(8):
        heaps, change = clustering.advance(heaps, x, centroids, offsets)
        total += change
        own = clustering.squared_distances(x, centroids).argmin(axis=1)
        assert (heaps.clusters() == own).all()
        assert (total[:, 6] == np.bincount(own, minlength=5)).all() and all((total[j, :6] == x[own == j].astype(np.int64).sum(axis=0)).all() for j in range(5))
        moved = total[:, :6] // total[:, 6:]
        drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1)) * (1 + clustering.SLACK)
        offsets, centroids = offsets + drift + np.array([np.delete(drift, j).max() for j in range(5)]), moved


def plain_fim(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text)
    return doc_id, n, "psm", a, b - a, sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


def test_fill_in_middle(spark, docs, rows, none):
    assert Counter(map(tuple, fim.digests(docs).collect())) == Counter(plain_fim(r[0], r[1]) for r in rows)
    rng = random.Random(8)
    odd = [(i, "".join(rng.choice(["<", "P", ">", "S", "M", "<P", "<M>", "é日", "\U0001f600", "ab" * 40, "x" * 3000]) for _ in range(rng.randrange(60)))) for i in range(300)]
    got = fim.digests(spark.createDataFrame(odd, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(plain_fim(*r) for r in odd)
    assert fim.digests(none).count() == 0


def test_fill_in_middle_carries_columns(docs):
    extra = docs.select("*", *(F.lit(7).alias(c) for c in ("h", "row", "n", "output", "h0", "made", "read", "a.b")))
    made = fim.fill_in_middle(extra)
    assert set(made.columns) == {*extra.columns, "n", "form", "prefix_chars", "middle_chars", "output"}
    assert made.filter("h = 7 and row = 7 and `a.b` = 7").count() == docs.count() and made.filter("form = 'plain' and coalesce(text, '') != output").count() == 0


def test_chunks_follow_content():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh é日") for _ in range(20_000)).encode()
    a, b = (fim.chunks(lead + shared) for lead in (b"", b"some other beginning " * 9))
    assert b"".join(a) == shared and len(set(a) & set(b)) > 0.8 * len(a)
    assert all(len(c) <= fim.MOST for c in a) and all(len(c) >= fim.LEAST for c in a[:-1])
    long = shared * 80  # more than is hashed at once
    assert b"".join(fim.chunks(long)) == long and fim.Document(long, Memo(fim.summary, 10)).n == len(long.decode())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.model_path(), "rb") as f:
        return pieces.Vocabulary(f.read())


def test_piece_codes(spark, docs, rows, none, small, library):
    real = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    for df, given in ((docs, [r[:2] for r in rows]), (spark.read.parquet(f"{small}/documents.parquet"), real)):
        want = Counter()
        for i, t in given:
            ids = library.encode(t or "")
            want[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))] += 1
        assert Counter(map(tuple, pieces.digests(df).collect())) == want
    assert pieces.digests(none).count() == 0


def test_codes_carry_columns(docs):
    extra = docs.select("*", *(F.lit(7).alias(c) for c in ("row", "read", "made", "ids", "decoded", "a.b")))
    out = pieces.decode(pieces.encode(extra))
    assert set(out.columns) == set(extra.columns) and out.filter("row = 7 and `a.b` = 7 and decoded = coalesce(text, '')").count() == docs.count()


def test_agenda_equals_the_library(vocabulary, library):
    rng = random.Random(3)
    some = [" ", "  ", "▁", "a", "b", "\n", "\t", "1", "0", "e", "<0x41>", "<s>", "/", "x", "é", "日本", "\U0001f600", "\x00", "ﬁ", "th", "in", "the", "er", "\r", "　"]
    encoder, decoder = pieces.Encoder(vocabulary, library), pieces.Decoder(vocabulary)
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["ab" * 5000, "=" * 999, " " * 300, "x" + " " * 300 + "y", "", None]
    for t, ids in zip(texts, encoder.all_ids(texts)):
        assert ids == library.encode(t or ""), t
    words = [w for w in encoder if w] + ["x" * n for n in range(1, 70)]
    assert pieces.merged_lot(words, vocabulary) == [pieces.merged(w, vocabulary) for w in words]
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), rng.randrange(3), 259, 28705, 264]) for _ in range(rng.randrange(8))]
        assert decoder.text(ids) == library.decode(ids), ids


def test_a_full_cache_starts_anew(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    monkeypatch.setattr(pieces, "TOGETHER", 30)
    texts = [f"word{k} and some more of them w{k % 3} " + "y" * 70 for k in range(20)]
    encoder = pieces.Encoder(vocabulary, library)
    assert list(encoder.all_ids(texts)) == library.encode(texts) and len(encoder) < 20


def test_a_difference_stops_the_job(vocabulary):
    class Other:
        def encode(self, x, **_):
            return [1]

    for text in ("some words", "\nword", "a  b"):
        with pytest.raises(RuntimeError):
            list(pieces.Encoder(vocabulary, Other()).all_ids([text]))


def test_models_of_other_kinds_are_refused():
    with open(pieces.model_path(), "rb") as f:
        data = f.read()
    with pytest.raises(ValueError):
        pieces.Vocabulary(data + bytes([0x12, 0x02, 0x18, 0x01]))  # a trainer that says unigram


def test_decode_of_odd_lists(spark):
    rows = [(1, None), (2, []), (3, [264, None, 287])]
    got = dict(pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).select("doc_id", "decoded").collect())
    assert got == {1: None, 2: "", 3: "a b"}
