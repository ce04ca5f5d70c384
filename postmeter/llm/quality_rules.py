"""Quality rules by distribution divergence, in DataFrame expressions only.

Every document's character-class histogram and its histogram of common words are compared by
Jensen-Shannon distance with references, the median share of every bin over all documents of its language. Histograms are counted
once, written as a table, and read for the references and again for the distances.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.llm.common import ROW, SPACE, WORD, durable, let, set_aside

#: The commonest function words of each supported language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for", "it", "on", "with", "was", "as", "are", "be", "by"],
    "de": ["der", "die", "und", "das", "in", "ist", "den", "von", "zu", "mit", "ein", "eine", "des", "auf", "dem", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "du", "en", "que", "qui", "est", "par", "pour", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "un", "por", "con", "no", "una", "para"],
}
#: The characters of each class; white space and the rest of the text are two more classes.
CHARACTER_CLASSES = {
    "digit": string.digits,
    "stop": ".,;:?'\"()-",
    "bang": "!",
    "symbol": "#*$%&|<>",
    "mark": "=_~^@{}[]\\/+`",
    "capital": string.ascii_uppercase,
}


def _none_of(characters: str) -> str:
    """A pattern for runs of other characters. Characters are listed one by one: Java then looks them up in a bit set."""
    return "[^" + "".join(f"\\{c}" if c in "[]\\^-&" else c for c in characters) + "]+"


#: What is left of a text without these runs is short, and the classes are counted on it.
UNMARKED = _none_of("".join(CHARACTER_CLASSES.values()))
#: A document with fewer words or characters is not held against a reference.
MIN_WORDS = 50
MIN_CHARACTERS = 200
#: Largest distance (0 to 1, base 2) at which a document still counts as ordinary prose.
MAX_CHARACTER_DISTANCE = 0.19
MAX_WORD_DISTANCE = 0.45
OTHER = "other"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "character_distance", "word_distance", "kept")


def _word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside windows of `window` words that stand at two places or more of the same array (a bound variable or a column).

    Windows are compared by 64-bit hash. Only a text with a repeated window is sorted: neighbours with one hash are
    repeats, and the gaps between their sorted starts give the number of covered words.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def repeats(s: Column) -> Column:
        twice = F.filter(s, lambda p, i: p["h"].eqNullSafe(F.get(s, i - 1)["h"]) | p["h"].eqNullSafe(F.get(s, i + 1)["h"]))
        return let(F.sort_array(F.transform(twice, lambda p: p["i"])), covered)

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeats))

    def hashed(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, window))))

    return let(hashed(words), count)


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)


def _common_text(words: Column) -> Column:
    """The words of the lists above that occur, each between two blanks of its own, for counting them by plain replacement."""
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    return F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w.isin(*listed)), "  "), F.lit(" "))


def _occurrences(spaced: Column, word: str) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(f" {word} "), F.lit("")))) / F.lit(len(word) + 2)).cast("double")


def with_histograms(docs: DataFrame, more=None) -> DataFrame:
    """docs with `_lang` (its language, or "other"), `_w` (n: words, chars: characters in them, more(words) as `more`),
    `_symbols` (count) and the histograms `_chars` and `_common` (array<double>)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(OTHER))

    def counted(w: Column) -> Column:
        extra = [] if more is None else [more(w).alias("more")]
        return F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _common_text(w).alias("common"), *extra)

    out = docs.withColumns({"_lang": lang, "_w": let(_word_list(text), lambda w: counted(w)), "_left": F.regexp_replace(text, UNMARKED, "")})
    common = F.lit(None).cast("array<double>")
    for name, listed in COMMON_WORDS.items():
        common = F.when(F.col("_lang") == name, F.array(*(_occurrences(F.col("_w.common"), w) for w in listed))).otherwise(common)
    classes = [F.length(F.regexp_replace("_left", _none_of(c), "")).cast("double") for c in CHARACTER_CLASSES.values()]
    spaces = (F.length(text) - F.col("_w.chars")).cast("double")
    out = out.withColumns({"_counts": F.array(spaces, *classes), "_c0": common, "_symbols": F.length(F.regexp_replace("_left", _none_of(CHARACTER_CLASSES["symbol"]), "")).cast("long")})
    rest = lambda total, counts: F.concat(F.array(F.greatest(total - _sum(F.col(counts)), F.lit(0.0))), F.col(counts))
    return out.withColumns({"_chars": rest(F.length(text), "_counts"), "_common": rest(F.col("_w.n"), "_c0")}).drop("_counts", "_left", "_c0")


def language_references(histograms: DataFrame) -> DataFrame:
    """histograms: `_lang`, `_chars`, `_common`. One row for each supported language that occurs and one for all others: the median share of every bin over all documents.

    Medians (approximate quantiles, kept as mergeable summaries) don't follow a minority of junk. At most
    len(COMMON_WORDS) + 1 rows whatever the input, so the table may be broadcast.
    """
    h = histograms.select("_lang", *(_shares(F.col(c)).alias(c) for c in ("_chars", "_common")))
    wide = {"_chars": len(CHARACTER_CLASSES) + 2, "_common": 1 + len(next(iter(COMMON_WORDS.values())))}
    medians = [F.percentile_approx(F.col(c)[i], 0.5, 1000).alias(f"{c}{i}") for c, n in wide.items() for i in range(n)]
    got = h.groupBy("_lang").agg(*medians)
    return got.select("_lang", *(_shares(F.array(*(F.coalesce(F.col(f"{c}{i}"), F.lit(0.0)) for i in range(n)))).alias(f"_ref{c}") for c, n in wide.items()))


def _shares(counts: Column) -> Column:
    return let(_sum(counts), lambda total: F.when(total > 0, F.transform(counts, lambda x: x / total)))


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence, base 2) of a histogram from a reference; null if either is empty."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(_shares(counts), reference, lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(_sum(terms), F.lit(0.0)))


def measure(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_characters: int = MIN_CHARACTERS,
    max_character_distance: float = MAX_CHARACTER_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    returned: list[str] | None = None,
) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, character_distance, word_distance and kept.

    returned: columns of docs to return; all if not given. A null text counts as empty: no words, base_failed true. A language that is
    null or not supported is held against the other such documents by character classes only. Below the minimum lengths a distance is
    null and decides nothing. Repeated rows are measured alike. Columns of docs by the names added here are replaced.
    """
    docs, own = set_aside(docs.drop(*ADDED), "text", "lang", kept=returned)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = with_histograms(docs, repeated_words).select(
        ROW,
        "_lang",
        "_chars",
        "_common",
        F.col("_w.n").alias("n_words"),
        F.col("_w.chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")).alias("n_dup_lines"),
        F.col("_w.more").alias("n_repeat_words"),
        F.length(text).alias("_length"),
    )
    counted = durable(counted)
    out = counted.join(F.broadcast(language_references(counted)), "_lang", "left").withColumns(
        {
            "character_distance": F.when((F.col("n_words") >= min_words) & (F.col("_length") >= min_characters), jensen_shannon(F.col("_chars"), F.col("_ref_chars"))),
            "word_distance": F.when(F.col("n_words") >= min_words, jensen_shannon(F.col("_common"), F.col("_ref_common"))),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = (F.coalesce("character_distance", F.lit(0.0)) > max_character_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~odd)
    return out.select(*own, *ADDED)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with docs' columns, that the rules keep."""
    docs, own = set_aside(docs, "text", "lang")
    return measure(docs, returned=[ROW]).filter("kept").select(*own)
