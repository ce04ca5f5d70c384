import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that for was kitchen river orange valley market station letter bridge window garden summer teacher doctor engine paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ","]) if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([1, 2, 3, 20, 60, 90, 200])) for _ in range(40)]
    passage = prose(rng, 50)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 20), passage + "\n" + prose(rng, 40), texts[6], texts[6], texts[6] + " extra"]
    texts += [None, "", " \t\n", "a", "word " * 400, prose(rng, 6000), "é日本 ñ " * 30, "x\x1cy\xa0z " * 40]
    texts += [
        "Write to jo.e_x+1@mail.example.com or a@b.c_d@e.fg, call +1 (743) 555-3824 or +12 3. ip 8.196.197.208 and 999.1.1.1 and 1.2.3.4.5.6.7.8",
        "card 4465 7583 8288 9437 and 4465758382889437, bad 4465758382889438; 1 2 3 4 5 6 7 8 9 " + "7" * 3000 + ' token = "1eb9c654e721b4f812088970e66a6345cee33dd6"',
        "Licensed under the Apache License, Version 2.0. See the MIT license; GNU General Public License, version 3. general public  LICENSE",
        "SPDX-License-Identifier: MIT\nmit mit license apache-license <|endoftext|> don't 12345",
        "line one two\nline one two\n\nother #*$ line\n" + "la la la la " * 20,
    ]
    langs, sources = ["en", "de", "fr", "es", None, "xx"], ["s1", "s2", None, "S3", "é"]
    out = [(i, t, langs[i % 6], sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[3], out[6], (None, texts[6], "en", "s1", 5), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
