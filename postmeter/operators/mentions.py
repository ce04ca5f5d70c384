"""Places of many literals in texts: one automaton over all of them, one pass over each text.

The literals of a vocabulary are collected in lots of at most LOT (the bound of what is sent to workers); a vocabulary of several lots is looked
for in as many passes, so no literal is left out. Regexes with a literal in them run only on texts where that literal stands.
"""

from __future__ import annotations

import re
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals that one automaton holds.
LOT = 50_000
_SPANS = "array<struct<start: int, end: int, literal: string>>"


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def automaton(literals):
    """Aho-Corasick automaton of (literal, payload) pairs; a literal's payloads are kept in a list."""
    import ahocorasick

    out = ahocorasick.Automaton()
    held: dict[str, list] = {}
    for literal, payload in literals:
        held.setdefault(literal, []).append(payload)
    for literal, payloads in held.items():
        out.add_word(literal, (len(literal), payloads))
    if held:
        out.make_automaton()
    return out if held else None


def required(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of a regex holds one at least, the set whose shortest is longest; empty if there is none
    (or the regex has syntax of its own)."""
    try:
        return tuple(sorted(_required(_parser.parse(pattern)) or ()))
    except (re.error, OverflowError):
        return ()


def _required(parsed) -> set[str] | None:
    found, run = [], ""
    for op, arg in [*parsed, ("END", None)]:
        kind = str(op)
        if kind == "LITERAL":
            run += chr(arg).lower()
            continue
        if run:
            found.append({run})
            run = ""
        if kind == "SUBPATTERN":
            found.append(_required(arg[-1]))
        elif kind == "BRANCH":
            sides = [_required(b) for b in arg[1]]
            found.append(set().union(*sides) if all(sides) else None)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found.append(_required(arg[2]))
    return max((f for f in found if f), key=lambda f: min(map(len, f)), default=None)


def bounded(text: str, start: int, end: int) -> bool:
    """Whether a place begins and ends where a word does (as \\b of regexes says)."""
    left = _word(text[start]) != (start > 0 and _word(text[start - 1]))
    return left and _word(text[end - 1]) != (end < len(text) and _word(text[end]))


def _finder(literals: list[str], whole: bool):
    @F.pandas_udf(_SPANS)
    def find(texts: pd.Series) -> pd.Series:
        a = automaton((x.lower(), x) for x in literals)

        def spans(t):
            if not t or a is None:
                return []
            low = t.lower()
            if len(low) != len(t):  # a character whose lower case is longer: places are those of the lower-cased text
                t = low
            hits = [(end + 1 - n, end + 1, x) for end, (n, own) in a.iter(low) for x in own if not whole or bounded(low, end + 1 - n, end + 1)]
            return [{"start": s, "end": e, "literal": x} for s, e, x in sorted(hits)]

        return texts.map(spans)

    return find


def found(df: DataFrame, literals: DataFrame, column: str, out: str = "mentions", whole: bool = True) -> DataFrame:
    """df plus out: every place (start, end, literal) where a literal (column literal of literals) stands in the text, in any case, as whole words
    (or, if whole is false, inside others too).

    Overlapping places are all listed, by start, end and literal. A null or empty text has an empty list; null and empty literals are skipped."""
    names = literals.select("literal").filter("literal <> ''").distinct()
    n = names.count()
    lots = max(1, -(-n // LOT))
    spans: Column | None = None
    for k in range(lots):
        some = [r[0] for r in names.filter(F.pmod(F.xxhash64("literal"), F.lit(lots)) == k).toLocalIterator()]
        one = _finder(some, whole)(F.col(f"`{column}`"))
        spans = one if spans is None else F.concat(spans, one)
    return df.withColumn(out, F.array_sort(spans) if lots > 1 else spans)
