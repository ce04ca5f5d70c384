"""Each operator against a plain rendering of its contract, on a fixture of odd cases."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postmeter.llm import classifier, decontaminate, licenses, lm, mixing, pii, quality_rules, simhash, substring, tokens

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall(t or "")


def collected(df):
    return Counter(tuple(r) for r in df.collect())


def test_license_scan(docs, rows):
    got = collected(licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    token, want = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), Counter()
    for i, t, *_ in rows:
        w = token.findall((t or "").translate(LOWER))
        places = [(k, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert got == want


def test_license_rules(spark, none):
    cases = {"SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "Released under the terms of the Mozilla Public License, v. 2.0": "mpl-2.0", "distributed under the GNU General Public License version 2": "gpl,gpl-2.0", "no licence here": ""}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.text: r for r in licenses.scan(df).collect()}
    assert {t: got[t].labels for t in cases} == cases
    assert all(0 <= r.score <= 1 for r in got.values()) and got["no licence here"].score == 0
    assert len(licenses.rules()) > 200 and licenses.scan(none).count() == 0


def expansions(pattern):
    """All strings of a rule's pattern: groups, alternatives, sets and optional parts."""
    from re import _parser

    def strings(parsed):
        out = [""]
        for op, arg in parsed:
            kind = str(op)
            if kind == "LITERAL":
                tails = [chr(arg)]
            elif kind == "IN":
                tails = [chr(c) for _, c in arg]
            elif kind == "BRANCH":
                tails = [x for b in arg[1] for x in strings(b)]
            elif kind == "SUBPATTERN":
                tails = strings(arg[-1])
            else:
                assert kind == "MAX_REPEAT" and arg[:2] == (0, 1)
                tails = ["", *strings(arg[2])]
            out = [a + b for a in out for b in tails]
        return out

    return strings(_parser.parse(pattern))


def test_every_rule_passes_its_gates():
    gate = set(licenses.gate())
    for _, _, label, pattern, firsts in licenses.rules():
        if not pattern.startswith(f"(?:{licenses.NOTICE_WORDS[0]}|"):  # a notice ends with a name, which has a rule of its own
            for example in expansions(pattern):
                assert example.split()[0] in firsts and gate & set(example.split()), (label, example)


def plain_labels(text):
    """Labels by trying every rule at every word, without gates or a bound on what a rule sees."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    compiled = [(p, label, k, re.compile(f"{pattern}(?= |$)")) for k, (p, _, label, pattern, _) in enumerate(licenses.rules())]
    found = []
    for at in range(len(w)):
        rest = " ".join(w[at : at + 80])
        best = min(((p, -len(m.group().split(" ")), k, label) for p, label, k, r in compiled if (m := r.match(rest))), default=None)
        if best:
            found.append((at, at - best[1], best[0], best[3]))
    inside = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or (e[2] == d[2] and e[1] - e[0] > d[1] - d[0]))
    kept = {d[3] for d in found if not any(inside(d, e) for e in found)}
    base = {label for phrase, label in licenses.BASE for k in range(len(w)) if tuple(w[k : k + len(phrase)]) == phrase}
    return ",".join(sorted(kept | base))


def test_labels_against_a_plain_rule_engine(spark, small, docs, rows):
    examples = [min(expansions(pattern), key=len) for _, _, _, pattern, _ in licenses.rules()]
    examples += ["distributed under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"]
    texts = [r[1] for r in rows] + examples + [f"a {x}, b {y}." for x, y in zip(examples, examples[7:])]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for d in (own, spark.read.parquet(f"{small}/documents.parquet")):
        wrong = [(r.text[:200], r.labels) for r in licenses.scan(d).select("text", "labels").collect() if r.labels != plain_labels(r.text)]
        assert not wrong


def test_signatures_are_distinct():
    patterns = [x[-1] for x in licenses.SIGNATURES]
    assert len(patterns) > 150 and len(set(patterns)) == len(patterns) and licenses.width() < 40


def test_names_without_the_word_license(spark):
    cases = {"Distributed under BSD 3-Clause": "bsd-3-clause", "MPL 2.0": "mpl-2.0", "under bsd 2-clause.": "bsd-2-clause", "in the public\ndomain": "public-domain", "Creative  Commons\nZero": "cc0-1.0", "All  rights\nreserved": "proprietary", "lgpl3": "lgpl-3.0", "bsd": ""}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.text: r.labels for r in licenses.scan(df).collect()} == cases


def print_of(t):
    w = (t or "").translate(LOWER)
    w = words(w)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """prints: list of fingerprints -> component index of each."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(prints))]


def test_simhash(docs, rows, none):
    prints = [print_of(r[1]) for r in rows]
    comp = groups(prints)
    least = defaultdict(list)
    for r, c in zip(rows, comp):
        least[c].append(r[0])
    want = Counter((r[0], f"{p:016x}", min((x for x in least[c] if x is not None), default=None)) for r, p, c in zip(rows, prints, comp))
    assert collected(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and {5, 12} <= set(got) and len(got) == len(set(got))
    first = {}
    for i, t, *_ in rows:
        if t is not None and i is not None:
            first.setdefault(t, i)
    assert not set(got) & ({i for i, t, *_ in rows if i is not None and first.get(t, i) != i})  # copies of an earlier text are gone
    assert simhash.keep_one(none).count() == 0


def shingles(t, n=5):
    w = words((t or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))}


def test_near_duplicates_by_similarity(spark):
    """Share of pairs linked by their true five-word similarity: nearly all from 0.8 on, hardly one below 0.6."""
    import random

    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, truth = [], []
    for k in range(500):
        w = rng.choices(vocabulary, k=rng.randrange(100, 400))
        v = list(w)
        for at in rng.sample(range(len(v)), rng.randrange(0, max(2, len(v) // 8))):
            v[at] = rng.choice(vocabulary)
        a, b = " ".join(w), " ".join(v)
        rows += [(2 * k, a), (2 * k + 1, b)]
        x, y = shingles(a), shingles(b)
        truth.append(len(x & y) / len(x | y))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [2 * k + 1 not in kept for k in range(500)]
    share = lambda lo, hi: np.mean([x for x, t in zip(linked, truth) if lo <= t < hi])
    assert all(2 * k in kept for k in range(500))
    assert share(0.8, 2) > 0.95 and share(0.85, 2) > 0.97 and share(0, 0.6) < 0.01


def test_large_group_of_near_copies(spark):
    """Thousands of near copies of one text are one group, found without comparing all pairs."""
    import random

    rng = random.Random(3)
    w = rng.choices([f"w{k}" for k in range(4000)], k=300)
    rows = []
    for k in range(2000):
        v = list(w)
        v[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(v)))
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_trie_join_finds_all_links():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    keys = [centre]
    for _ in range(600):
        k = keys[rng.integers(len(keys))]
        for b in rng.choice(48, rng.integers(0, 5), replace=False):
            k ^= np.uint64(1) << np.uint64(b)
        keys.append(k)
    keys = np.unique(np.array(keys, np.uint64))
    got = simhash.trie_components(keys, np.array([0]), 16)
    want = groups([int(k) for k in keys])
    assert len(set(zip(got.tolist(), want))) == len(set(got.tolist())) == len(set(want))


@pytest.mark.parametrize("split", [1, 3, 50_000])
def test_links_over_split_buckets(spark, split):
    """Hot buckets are dealt again without losing a link, batch borders within a bucket included."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    keys = []
    for c in centres:
        for _ in range(150):
            k = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                k ^= 1 << int(b)
            keys.append(k)
    keys = sorted(set(keys))
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        edges = simhash.links(spark.createDataFrame([(k,) for k in signed], "fp long"), split)
        linked = {r.node: r.root for r in simhash.components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = [linked.get(k, k) for k in signed]
    want = groups(keys)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_decontamination(spark, docs, none):
    item = "Whose orange garden met seven quiet doctors near that old bridge while summer letters fell across paper markets"
    w = item.split()
    swapped = " ".join("changed" if k in (6, 13) else x for k, x in enumerate(w))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    extra = spark.createDataFrame([(900, "aa bb cc " + item.upper() + " dd"), (901, "x " + swapped + " y"), (902, " ".join(w[:6])), (903, "some tiny item here")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(extra, bench).collect()}
    assert {i: r.item_ids for i, r in got.items()} == {900: "1", 901: "1", 902: "", 903: "4"}
    assert got[900].best_overlap == 1.0
    clean = decontaminate.drop_contaminated(docs.withColumn("n_items", F.lit("own")), bench)
    assert clean.count() == docs.count() and clean.columns == [*docs.columns, "n_items"] and clean.first().n_items == "own"
    assert decontaminate.contamination(none, bench).count() == 0


def test_decontamination_finds_substitutions_at_every_place(spark):
    from itertools import combinations

    rows, want = [], {}
    names = lambda n, k: [f"w{n}x{j}" for j in range(k)]
    bench = [(n, " ".join(names(n, n))) for n in range(6, 15)]
    for n in range(6, 15):
        for k in (1, 2):
            for gone in combinations(range(n), k):
                w = ["other" if j in gone else x for j, x in enumerate(names(n, n))]
                widths = range(min(n, 12), n + 1)
                hit = any(sum(a <= j < a + s for j in gone) <= s - 0.8 * s for s in widths for a in range(n - s + 1))
                rows.append((len(rows), "before " + " ".join(w) + " after"))
                want[rows[-1][0]] = str(n) if hit else ""
    both = "z " + " ".join(["other", *names(99, 30)[1:11], "other"]) + " z"
    rows.append((-1, both))
    want[-1] = "99"
    bench.append((99, " ".join(names(99, 30))))
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {r.doc_id: r.item_ids for r in got.collect()} == want


def test_overlap_is_the_longest_stretch():
    rng = np.random.default_rng(4)
    for _ in range(400):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.75, 0.9])
        need = int(rng.integers(1, 14))
        sizes = [e - s for s in range(len(same)) for e in range(s + need, len(same) + 1) if 5 * same[s:e].sum() >= 4 * (e - s)]
        got = decontaminate.overlap(same, need)
        assert (got[1] if got else None) == max(sizes, default=None)


def test_seeds_find_substituted_stretches():
    """Share of stretches with as many unequal tokens as allowed, at random places, that some mask finds."""
    rng = np.random.default_rng(6)
    masks = decontaminate.masks_for([])[0]
    for size, gone, least in ((12, 2, 1.0), (15, 3, 0.98), (20, 4, 0.98), (30, 6, 0.98)):
        hit = 0
        for _ in range(1000):
            bad = set(rng.choice(size, gone, replace=False).tolist())
            hit += any(all(m[k] == "0" or a + k not in bad for k in range(len(m))) for m in masks for a in range(size - len(m) + 1))
        assert hit / 1000 >= least, (size, hit)


def test_decontamination_against_brute_force(spark, small):
    """Every item against every document of the given tables, along every diagonal."""
    d, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, decontaminate.tokens_of(r.text)) for r in bench.collect()]
    got = {r.doc_id: (r.item_ids, round(r.best_overlap, 9)) for r in decontaminate.contamination(d, bench).collect()}
    for r in d.collect():
        w, found, best = decontaminate.tokens_of(r.text), [], 0.0
        places = defaultdict(list)
        for k, t in enumerate(w):
            places[t].append(k)
        for i, tokens in items:
            diagonals = Counter(p - k for k, t in enumerate(tokens) for p in places[t])
            need = min(12, len(tokens))
            sizes = []
            for g in (g for g, n in diagonals.items() if n >= 0.8 * need):
                lo, hi = max(0, g), min(len(w), g + len(tokens))
                size = decontaminate.overlap(np.array([w[k] == tokens[k - g] for k in range(lo, hi)]), need)
                if size:
                    sizes.append(size[1] / len(tokens))
            if sizes:
                found.append(i)
                best = max(best, *sizes)
        assert got[r.doc_id] == (",".join(map(str, sorted(found))), round(best, 9)), r.doc_id


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m.group()))


def test_pii(docs, rows, none):
    want = Counter()
    for i, t, *_ in rows:
        s = spans(t)
        stated = ",".join(f"{n}:{a}:{e}" for a, _, n, e in s)
        want[(i, *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(stated.encode()).hexdigest())] += 1
    found = pii.find(docs)
    assert collected(found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == want
    assert any("secret:" in r.spans for r in found.select("spans").collect())
    assert pii.find(none).count() == 0


def secrets(rng, n):
    """(text, true or not): true secrets and hashes of other things, with the words that stand before such."""
    out = []
    for k in range(n):
        true = k % 2 == 0
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))
        mixed = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(36))
        body = (hexes if rng.random() < 0.5 else mixed) if true else hexes
        word = rng.choice(["token", "api_key", "secret", "password"] if true else ["commit", "sha1", "checksum", "revision"])
        if rng.random() < 0.15:
            word = "bearer" if true else "build"  # a word that no labeler knows
        out.append((f"some words {word}: {body} more words", true))
    return out


def test_span_classifier_decides(spark):
    """Added kinds on labelled traps: hashes that aren't secrets, account numbers and ids that fail their check sums."""
    import random

    rng = random.Random(9)
    labelled = secrets(rng, 400)
    numbers = [(f"order {rng.randrange(10**15, 10**16)} shipped, release 4.{k}.300.{900 + k}", False) for k in range(60)]
    ibans = [("account GB82 WEST 1234 5698 7654 32 please", True), ("account DE89 3704 0044 0532 0130 00 please", True), ("order XX11 ABCD 1234 5678 9012 34 please", False), ("order QQ12 ABCD 1234 5678 9012 35 please", False)] * 15
    texts = labelled + numbers + ibans
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(d).collect()}
    for kind, least in (("secret", 0.85), ("iban", 0.95)):
        own = [(true, f"{kind}:" in got[k].spans) for k, (t, true) in enumerate(texts) if (k < 400) == (kind == "secret") and (k < 400 or k >= 460)]
        hit = sum(a and b for a, b in own)
        precision, recall = hit / max(sum(b for _, b in own), 1), hit / sum(a for a, _ in own)
        assert precision >= least and recall >= least, (kind, precision, recall)


def test_reliabilities_settle():
    """EM recovers the rates of labelers from their votes alone, and stops by itself."""
    rng = np.random.default_rng(2)
    counts = Counter()
    for _ in range(20_000):
        true = rng.random() < 0.7
        v = [0] * len(pii.LABELERS)
        for k, (right, votes) in enumerate([(0.95, 0.9), (0.8, 0.9), (0.7, 0.8), (0.9, 0.5)]):
            if rng.random() < votes:
                v[k] = 1 if (rng.random() < right) == true else -1
        counts[tuple(v)] += 1
    got = pii.Reliabilities([(0, v, float(n)) for v, n in sorted(counts.items())])
    assert got.rounds < pii.ROUNDS and abs(got.prior[0] - 0.7) < 0.03
    assert abs(got.rates[0][0][True][2] - 0.95 * 0.9) < 0.03 and abs(got.rates[0][1][False][0] - 0.8 * 0.9) < 0.03


def test_long_secrets_and_addresses_are_whole(spark):
    long = "a1B2" * 400
    mail = "x" * 90 + " at " + "y" * 80 + " dot " + "z" * 30
    d = spark.createDataFrame([(1, f"token: {long}."), (2, f"mail {mail}.")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(d).collect()}
    assert f"secret:7:{7 + len(long)}" in got[1].split(",") and f"spelled_email:5:{5 + len(mail)}" in got[2].split(",")


def test_redaction(docs, rows):
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    by_text = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in clean.collect():
        if r.doc_id is not None and not spans(by_text[r.doc_id]) and "token" not in (by_text[r.doc_id] or ""):
            assert r.text == by_text[r.doc_id]
        assert not spans(r.text)


def test_lm(docs, rows, none):
    toks = [[*words((t or "").translate(LOWER)), None] for _, t, *_ in rows]
    trains = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    c = Counter(x for w, tr in zip(toks, trains) if tr for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], not tr, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for r, w, tr in zip(rows, toks, trains))
    got = lm.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))
    assert collected(got) == want
    assert lm.score(none).count() == 0


def test_lm_is_a_distribution(docs):
    """Over every class the model's probabilities sum to one, words never seen included."""
    counts = lm.word_counts(docs.select("text", lm.in_training(F.col("doc_id")).alias("train")))
    v = lm.Vocabulary(counts)
    ids = np.array([r[0] for r in counts.filter("n > 0").select("id").collect()], np.int64).view(np.uint64)
    cell, n, hit = v.look_up(ids)
    exact = {r.id: r.n for r in counts.collect()}
    share = np.zeros(lm.CLASSES * lm.CELLS)
    for i, k in zip(ids.view(np.int64).tolist(), cell):
        share[k] += (exact[i] + 1) / v.room[k]
    seen = np.unique(cell)
    own = seen < lm.OWN
    assert np.allclose(v.class_share.sum(), 1) and np.allclose(v.cell_share.sum(axis=1), 1)
    assert np.allclose(share[seen[own]], 1)
    assert np.allclose(share[seen[~own]] + 1 / v.room[seen[~own]], 1)


def test_lm_scores_are_the_same_however_documents_are_dealt(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = [{r.doc_id: r.score for r in lm.score(d.repartition(n)).collect()} for n in (1, 7)]
    assert all(math.isclose(got[0][i], got[1][i], rel_tol=1e-6) for i in got[0])


def test_lm_learns_from_history(spark, small):
    """Held-out documents: the model's score a token is above that of word shares by a stated margin."""
    r = lm.score(spark.read.parquet(f"{small[:-5]}0.01/documents.parquet")).filter("held_out").agg(F.sum("n_tokens"), F.sum("score"), F.sum("base_score")).first()
    assert r[1] / r[0] > r[2] / r[0] + 0.1


def test_mixing(docs, rows, none):
    m = mixing.mix(docs).collect()
    assert len(m) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, full = 1.5 * sum(size.values()), set()
    while True:
        left = budget - sum(2 * size[s] for s in full)
        level = left / sum(weight[s] for s in size if s not in full)
        over = {s for s in size if s not in full and weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * size[s] if s in full else weight[s] * level for s in size}
    taken = defaultdict(int)
    for r in m:
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"] and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in size)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, m)) == Counter(map(tuple, again))
    assert mixing.mix(none).count() == 0
    placed = mixing.mixed_order(mixing.mix(docs)).select("finish").collect()
    assert [r[0] for r in placed] == sorted(r[0] for r in placed)


def test_queue_is_cut_where_the_budget_is_spent(docs):
    """The cut of the range-sorted turns against a plain walk over all turns in order of finish."""
    queue = mixing.queued(docs)
    listed = mixing.turns(queue).collect()
    finish = [r.finish for r in listed]
    assert finish == sorted(finish) and len(listed) == 2 * queue.filter("source_size > 0").count()
    sources = {r.source: (r.weight, r.source_size) for r in queue.collect() if r.source_size}
    total = sum(n for _, n in sources.values())
    for budget in (0.1 * total, total, 1.5 * total, 1.99 * total):
        served = lambda v: sum(min(2 * n, w * v) for w, n in sources.values())
        v = mixing.cut(queue, budget)
        assert math.isclose(served(v), budget, rel_tol=1e-9)
    assert mixing.cut(queue, 3 * total) == math.inf


def test_mixing_ties_and_clashing_columns(spark):
    """Repeated rows have equal tickets; they share their places and no word is lost. Empty sources take nothing."""
    rows = [(1, "a b c", "x", 1)] * 5 + [(2, "d e", "y", 2), (3, None, "z", 3), (4, "", None, 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, finish int")
    m = mixing.mix(d).collect()
    assert len(m) == 8 and sum(r.taken for r in m if r.source == "x") == round(next(r.target for r in m if r.source == "x"))
    assert {r.taken for r in m if r.source in ("z", None)} == {0}


def test_mixing_matches_its_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    names = ["doc_id", "source", "size", "source_size", "target", "taken", "finish"]
    got = Counter(tuple(r) for r in mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).select(*names).collect())
    assert got == Counter(con.execute(f"select {', '.join(names)} from ({mixing.ORACLE_SQL})").fetchall())


def test_quality_rules(docs, rows, none):
    want = Counter()
    for i, t, *_ in rows:
        w, t = words(t), t or ""
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = quality_rules.measure(docs)
    assert collected(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    assert got.filter("kept and base_failed").count() == 0 and got.filter("kept is null").count() == 0
    clash = quality_rules.keep_good(docs.withColumn("kept", F.lit("mine")))
    assert clash.columns == [*docs.columns, "kept"] and clash.count() == got.filter("kept").count()
    assert quality_rules.measure(none).count() == 0


def plain_distance(p, q):
    p, q = np.asarray(p, float), np.asarray(q, float)
    p = p / p.sum()
    m = (p + q) / 2
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max((part(p) + part(q)) / 2, 0))


def test_quality_verdicts_against_a_second_rendering(spark, small):
    """Histograms, median references, Jensen-Shannon distances and verdicts by plain Python over all documents."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()
    classes = quality_rules.CHARACTER_CLASSES

    def histograms(r):
        w, t = words(r.text), r.text or ""
        counts = [sum(map(t.count, "".join(c))) for c in classes.values()]
        spaces = len(t) - sum(map(len, w))
        chars = [max(len(t) - spaces - sum(counts), 0), spaces, *counts]
        listed = quality_rules.COMMON_WORDS.get(r.lang)
        common = None
        if listed:
            seen = Counter(w)
            own = [seen[x] for x in listed]
            common = [max(len(w) - sum(own), 0), *own]
        return chars, common

    made = {r.doc_id: (r, *histograms(r)) for r in rows}
    groups = defaultdict(list)
    for r, chars, common in made.values():
        groups[r.lang if r.lang in quality_rules.COMMON_WORDS else "other"].append((chars, common))

    def reference(parts):
        shares = np.array([np.array(x, float) / sum(x) for x in parts if x is not None and sum(x)])
        medians = np.sort(shares, axis=0)[(len(shares) + 1) // 2 - 1]
        return medians / medians.sum()

    refs = {g: (reference([c for c, _ in xs]), reference([c for _, c in xs]) if g != "other" else None) for g, xs in groups.items()}
    got = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    for i, (r, chars, common) in made.items():
        g = r.lang if r.lang in quality_rules.COMMON_WORDS else "other"
        m, n = got[i], len(words(r.text))
        if n >= 50 and len(r.text) >= 200:
            assert abs(m.character_distance - plain_distance(chars, refs[g][0])) < 5e-3, i
        if n >= 50 and common:
            assert abs(m.word_distance - plain_distance(common, refs[g][1])) < 5e-3, i
        odd = (m.character_distance or 0) > quality_rules.MAX_CHARACTER_DISTANCE or (m.word_distance or 0) > quality_rules.MAX_WORD_DISTANCE
        assert m.kept == (not m.base_failed and not odd)


def test_quality_rules_tell_junk(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    known = quality_rules.measure(d).filter("not base_failed").join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in known) / len(known) > 0.97


def test_substring(docs, rows, none):
    w = [words(r[1]) for r in rows]
    seen = Counter(tuple(x[k : k + 35]) for x in w for k in range(len(x) - 34))
    want = Counter()
    for r, x in zip(rows, w):
        gone = {k + j for k in range(len(x) - 34) if seen[tuple(x[k : k + 35])] > 1 for j in range(35)}
        kept = " ".join(t for k, t in enumerate(x) if k not in gone)
        want[(r[0], len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert collected(substring.deduplicate(docs)) == want
    assert substring.deduplicate(none).count() == 0


def test_index_runs_and_compaction(spark):
    index = substring.FingerprintIndex(spark, fan_in=1)
    batch = lambda *x: spark.createDataFrame([(i, 1) for i in x], "fp long, n tinyint")
    found = [sorted({r[0] for r in index.add(batch(*b)).collect()}) for b in ([1, 2, 2], [2, 3], [1, 4], [4, 5])]
    assert found == [[2], [2], [1], [4]] and len(index.runs) == 2


def test_saved_index_goes_on(spark, tmp_path):
    """An index opened again on its path knows what earlier batches held; compacted runs replace their files."""
    at, batch = str(tmp_path / "index"), lambda *x: spark.createDataFrame([(i, 1) for i in x], "fp long, n tinyint")
    found = [sorted({r[0] for r in substring.FingerprintIndex(spark, at).add(batch(*b)).collect()}) for b in ([1, 2, 2], [2, 3], [1, 4], [4, 5])]
    assert found == [[2], [2], [1], [4]] and len(os.listdir(at)) == 2


def test_two_incremental_calls_equal_one(spark, docs, rows, tmp_path):
    numbered = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string")
    first, second = numbered.filter("doc_id % 2 = 0"), numbered.filter("doc_id % 2 = 1")
    at = str(tmp_path / "index")
    substring.deduplicate(first, index=substring.FingerprintIndex(spark, at)).count()
    got = collected(substring.deduplicate(second, index=substring.FingerprintIndex(spark, at), history=first))
    assert got == collected(substring.deduplicate(numbered).filter("doc_id % 2 = 1"))


def test_substring_matches_its_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got = collected(substring.deduplicate(spark.read.parquet(f"{small}/documents.parquet")))
    assert got == Counter(con.execute(f"select doc_id, n_words, n_removed, kept_sha256 from ({substring.ORACLE_SQL})").fetchall())


def test_substring_compacts_and_removes_replaced_runs(docs, monkeypatch):
    """The query itself compacts, not only an index of its own; the replaced runs leave the disk."""
    before, compact = [], substring.FingerprintIndex.compact

    def watched(index):
        replaced = list(index.runs)
        compact(index)
        before.append((len(replaced), len(index.runs)))
        assert not any(os.path.exists(r._durable_at.removeprefix("file:")) for r, _ in replaced)
        assert os.path.exists(index.runs[0][0]._durable_at.removeprefix("file:"))

    monkeypatch.setattr(substring.FingerprintIndex, "compact", watched)
    substring.deduplicate(docs).count()
    assert before == [(2, 1)]


def test_substring_when_entries_are_planned_anew(docs, monkeypatch):
    """Batches read under other file splits, as after an executor is lost or joins, still hold every entry once."""
    want = collected(substring.deduplicate(docs))
    add = substring.FingerprintIndex.add

    def moved(index, batch):
        conf = batch.sparkSession.conf
        before = conf.get("spark.sql.files.maxPartitionBytes")
        conf.set("spark.sql.files.maxPartitionBytes", ("100", "100000000", "350")[len(index.runs) % 3])
        conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            return add(index, batch)
        finally:
            conf.set("spark.sql.files.maxPartitionBytes", before)
            conf.unset("spark.sql.files.openCostInBytes")

    monkeypatch.setattr(substring.FingerprintIndex, "add", moved)
    assert collected(substring.deduplicate(docs)) == want


def test_token_counts(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    n = [len(e.ids) for e in t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    want = Counter((r[0], len((r[1] or "").encode()), k, k > 1024) for r, k in zip(rows, n))
    assert collected(tokens.count_tokens(docs.select("doc_id", "text")).drop("text")) == want
    assert tokens.count_tokens(none).count() == 0


def test_classifier(spark, small, none):
    d, labels = spark.read.parquet(f"{small[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{small[:-5]}0.01/labels.parquet")
    scored = classifier.score_quality(d, labels)
    known = scored.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in known) / len(known) > 0.95
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert classifier.score_quality(none, labels).count() == 0


def test_classifier_counts_labels_of_documents_only(docs, spark):
    """The bound on labelled rows is spent on labels that have a document: a thousand others leave the fit as it is."""
    few = [(i, i % 2) for i in range(40)]
    many = few + [(100_000 + i, i % 2) for i in range(1000)]
    a, b = (classifier.score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int"), max_labelled=30) for x in (few, many))
    assert collected(a) == collected(b)


def test_classifier_without_labels(docs, spark):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in classifier.score_quality(docs, labels).collect()} == {0.5}


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    at, texts = docs, {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, at, small)
        assert out.columns == docs.columns
        at = out.cache()
        texts[name] = {r.doc_id: r.text for r in at.collect()}
    kept = quality_rules.measure(docs).filter("kept").count()
    assert len(texts["quality_rules"]) == kept
    before, after = texts["quality_rules"], set(texts["near_dedup"])
    sets = {i: shingles(t) for i, t in before.items()}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    assert after <= set(before) and min(before) in after
    assert all(any(x > 0.6 and i in p for p, x in alike.items()) for i in set(before) - after)  # nothing goes without a likeness
    assert sum({i, j} <= after for (i, j), x in alike.items() if x >= 0.8) == 0
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(b in t for t in texts["decontamination"].values() for b in bench)
    assert set(texts["pii"]) == set(texts["decontamination"]) and not any(spans(t) for t in texts["pii"].values())
    mixed = p.STAGES[-1][1](spark, at, small)
    assert {r.doc_id for r in mixed.collect()} == set(texts["pii"])


@pytest.mark.parametrize("texts", [[None], [""], ["a b c"]])
def test_single_rows(spark, texts):
    d = spark.createDataFrame([(1, t, None, None, None) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for f in (licenses.scan, simhash.near_duplicates, pii.find, pii.redact, lm.score, mixing.mix, quality_rules.measure, substring.deduplicate, tokens.count_tokens):
        assert f(d).count() == 1
