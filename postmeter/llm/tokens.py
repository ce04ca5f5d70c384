"""Token counts by a map-side two-tier lookup.

First tier: a broadcast table of the lengths, in tokens, of the corpus' frequent pre-tokens. Second tier: a cache in each
worker, filled by encoding what the first tier misses. Pre-tokens themselves are never shuffled: only each task's bounded
list of frequent candidates is.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmeter.llm.common import batches_of

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the pattern by which byte-level BPE of this family cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the frequent table, of what one task names for it, and of each worker's cache and counter.
FREQUENT, PER_TASK, CACHE, COUNTED = 50_000, 20_000, 200_000, 200_000
#: Characters that are counted together, and pieces that go to the library at once: they bound a worker's memory.
PIECE_CHARACTERS, ENCODED = 2_000_000, 2_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _specials(tokenizer) -> list[str]:
    return sorted((a.content for a in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)


def _pieces(text: str, specials) -> tuple[list[str], int]:
    """Stretches of ordinary text, and how many special strings stand between them (a token each)."""
    if specials is None:
        return [text], 0
    parts = specials.split(text)
    return parts, len(parts) - 1


def _special_pattern(found: list[str]):
    return regex.compile("|".join(map(regex.escape, found))) if found else None


#: Code points that the two libraries' Unicode tables may class differently: a text with one is encoded whole.
DOUBTFUL = regex.compile("[՘֋֌࢏౜೜₏₝-₟꟎-ꟿ꭬꭭\U00010000-\U0001efff\U00020000-\U0010ffff]")


def frequent_lengths(docs: DataFrame, path: str, most: int = FREQUENT) -> dict[str, int]:
    """Lengths in tokens of frequent pre-tokens, at most `most` (the bound of what is broadcast), named by all documents.

    Every task names its most frequent candidates (at most PER_TASK); which ones are found affects speed only, never a count.
    """

    def name(batches):
        found: Counter = Counter()
        find, special = regex.compile(PRE_TOKEN).findall, _special_pattern(_specials(_library(path)))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for part in _pieces(text, special)[0]:
                        found.update(find(part))
                    if len(found) > COUNTED:
                        found = Counter(dict(found.most_common(COUNTED // 4)))
        top = [(k, v) for k, v in found.most_common(PER_TASK) if v > 1]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k for k, _ in top], pa.string()), "n": pa.array([v for _, v in top], pa.int64())})

    named = docs.select("text").mapInArrow(name, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r[0] for r in named.orderBy(F.desc("n"), "piece").limit(most).select("piece").collect()]
    tokenizer = _library(path)
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False))}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """docs plus n_bytes, n_tokens and over_limit (n_tokens > limit), as the library at path counts the whole text.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows are counted alike; columns of docs by the added names
    are replaced. A special string inside a text is one token, the library's default.
    """
    path = path or tokenizer_path()
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    sc = docs.sparkSession.sparkContext
    lengths = sc.broadcast(frequent_lengths(docs, path))

    def count(batches):
        tokenizer = _library(path)
        special = _special_pattern(_specials(tokenizer))
        find, first, cache = regex.compile(PRE_TOKEN).findall, lengths.value, {}
        for batch in batches:
            texts, sums = batch.column("text").to_pylist(), []
            for lo, hi in batches_of(texts, PIECE_CHARACTERS):
                counts, pending = [], {}  # pending: rows of pieces that neither tier knows
                for row, text in enumerate(texts[lo:hi]):
                    total = 0
                    if text and DOUBTFUL.search(text):
                        total = len(tokenizer.encode(text, add_special_tokens=False).ids)
                    elif text:
                        parts, total = _pieces(text, special)
                        for part in parts:
                            for piece in find(part):
                                n = first.get(piece) or cache.get(piece)
                                if n:
                                    total += n
                                else:
                                    pending.setdefault(piece, []).append(row)
                    counts.append(total)
                missed = list(pending)
                if len(cache) + len(missed) > CACHE:
                    cache.clear()
                for k in range(0, len(missed), ENCODED):
                    some = missed[k : k + ENCODED]
                    for piece, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                        n = cache[piece] = len(e.ids)
                        for row in pending[piece]:
                            counts[row] += n
                sums += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])
    out = docs.mapInArrow(count, schema)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select(*docs.columns, n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
