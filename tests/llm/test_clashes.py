"""Columns of docs by any name that an operator uses inside itself change no result and come back; a doc_id may stand on several texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postmeter.llm import classifier, clustering, decontaminate, fim, licenses, lm, mixing, pieces, pii, quality_rules, simhash, substring, tokens

#: Names that operators add or work with.
NAMES = (
    "_row _scan _seen _words _own _rank _lang _left _length _chars _common _w _symbols _counts _c0 _ref_chars _spans _clean clean found items ids node root wide least fp h at n made read row fold key "
    "_doc _found_own hits tokens words size target taken finish source_size x quality score kept labels detections spans n_words n_base base_failed form output decoded cluster distance held_out own "
    "item place diagonal share contaminated n_items item_ids best_overlap n_bytes n_tokens over_limit component_id fingerprint piece r u v start end"
).split()


@pytest.fixture(scope="module")
def crowded(docs):
    return docs.select("*", *(F.lit(7).alias(c) for c in NAMES))


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    long = max((r[1] for r in rows if r[1] and len(r[1]) < 2000), key=len)
    return spark.createDataFrame([(1, " ".join(long.split()[:30])), (2, None), (None, "words of nobody"), (3, "")], "item_id long, text string")


def multiset(df):
    return Counter(map(str, df.collect()))


CASES = {
    "licenses": (lambda d, b: licenses.scan(d), ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")),
    "simhash": (lambda d, b: simhash.near_duplicates(d), ("fingerprint", "component_id")),
    "contamination": (decontaminate.contamination, ("contaminated", "n_items", "item_ids", "best_overlap")),
    "pii": (lambda d, b: pii.find(d), ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found")),
    "mixing": (lambda d, b: mixing.mix(d), ("size", "source_size", "target", "taken")),
    "quality_rules": (lambda d, b: quality_rules.measure(d), quality_rules.ADDED),
    "substring": (lambda d, b: substring.deduplicate(d), ("n_words", "n_removed", "kept_sha256")),
    "tokens": (lambda d, b: tokens.count_tokens(d), ("n_bytes", "n_tokens", "over_limit")),
    "fim": (lambda d, b: fim.fill_in_middle(d), ("n", "form", "prefix_chars", "middle_chars", "output")),
    "pieces": (lambda d, b: pieces.decode(pieces.encode(d)), ("ids", "decoded")),
}


@pytest.mark.parametrize("name", CASES)
def test_operators(docs, crowded, benchmark, name):
    run, added = CASES[name]
    plain, full = run(docs, benchmark), run(crowded, benchmark)
    assert multiset(full.select("doc_id", *added)) == multiset(plain.select("doc_id", *added))
    carried = [c for c in NAMES if c in full.columns and c not in added]
    if "text" in full.columns:
        assert set(full.columns) >= {*crowded.columns} - {*added} and not full.filter(" or ".join(f"`{c}` <> 7 or `{c}` is null" for c in carried)).take(1)


def test_models(spark, docs, crowded):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert multiset(classifier.score_quality(crowded, labels)) == multiset(classifier.score_quality(docs, labels))
    assert multiset(lm.score(crowded)) == multiset(lm.score(docs))


def test_vectors(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(30)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert multiset(clustering.cluster(plain.select("*", *(F.lit(7).alias(c) for c in NAMES)), k=3, rounds=2, dims=2)) == multiset(clustering.cluster(plain, k=3, rounds=2, dims=2))


STAGES = {
    "quality": lambda d, b: quality_rules.keep_good(d),
    "near_dedup": lambda d, b: simhash.keep_one(d),
    "decontamination": decontaminate.drop_contaminated,
    "personal_data": lambda d, b: pii.redact(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages(docs, crowded, none, benchmark, name):
    plain, full = STAGES[name](docs, benchmark), STAGES[name](crowded, benchmark)
    assert full.columns == crowded.columns and plain.columns == docs.columns
    assert multiset(full.select(*docs.columns)) == multiset(plain) and full.filter("_own = 7 and _rank = 7 and items = 7").count() == full.count()
    assert STAGES[name](none, benchmark).count() == 0
    assert STAGES[name](crowded.limit(0), benchmark).columns == crowded.columns


def test_a_doc_id_on_several_texts_loses_none(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    df = spark.createDataFrame([(7, a, "en", "s", 1), (7, b, "en", "s", 1), (8, a, "en", "s", 1), (7, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == [(7, a), (7, b)]


def test_near_dedup_keeps_a_row_of_every_group(docs):
    """As many rows as there are groups, each group's least doc_id, whatever ids repeat."""
    kept = simhash.keep_one(docs)
    again = simhash.keep_one(kept)
    assert multiset(again) == multiset(kept)
    assert {r.text.lower() for r in docs.collect() if r.text and len(r.text.split()) > 30} >= {r.text.lower() for r in kept.collect() if r.text and len(r.text.split()) > 30}


def test_pipeline_of_odd_documents(docs, none, small, spark):
    for start in (docs, none):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, small)
        assert out.count() <= start.count()
