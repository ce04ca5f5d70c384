"""Fill-in-middle: documents are cut at two random places and their parts told apart by marks.

Texts are UTF-8. A rolling hash of the last 16 bytes cuts them into chunks wherever the same bytes stand, so passages that documents
share give the same chunks. A worker's cache knows each chunk by its content and holds its summary: how many code points start in it, whether a
mark stands in it, and what of a mark it may begin or end. A document's length, its marks and the chunks of its two cuts follow from the
summaries alone; only the two chunks with a cut are looked into.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmeter.llm.common import Memo, byte_column

#: Fixed values of the task: marks of prefix, suffix and middle, and shares (in 100) of plain and of suffix-first documents.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Bytes that the rolling hash sees; a chunk ends where the hash's top CUT_BITS are zero, between the least and the most bytes.
SEEN, CUT_BITS, LEAST, MOST = 16, 8, 64, 2048
#: Chunks of a worker's cache, and bytes hashed at once.
CACHED, HASHED = 30_000, 1 << 20
_GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, dtype=np.uint32)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash ends a chunk. It is the sum of the bytes' random numbers, each shifted by its age."""
    h = _GEAR[data]
    width = 1
    while width < SEEN:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunks(text: bytes) -> list[bytes]:
    """text cut where its content says, into pieces of LEAST to MOST bytes (the last one may be shorter)."""
    out, began, data = [], 0, np.frombuffer(text, np.uint8)
    for lo in range(0, len(text), HASHED):
        before = min(lo, SEEN - 1)
        places = _cuts(data[lo - before : lo + HASHED]) - before
        for at in (places[places > 0] + lo).tolist():
            while at - began > MOST:
                out.append(text[began : began + MOST])
                began += MOST
            if at - began >= LEAST:
                out.append(text[began:at])
                began = at
    while len(text) - began > MOST:
        out.append(text[began : began + MOST])
        began += MOST
    if began < len(text):
        out.append(text[began:])
    return out


class Summary(NamedTuple):
    """Of a chunk: code points that start in it, whether a mark stands in it, what it ends with of a mark, and its first two bytes."""

    points: int
    marked: bool
    tail: bytes
    head: bytes


def _starts(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)


def summary(chunk: bytes) -> Summary:
    tail = next((chunk[-n:] for n in (2, 1) if any(m.startswith(chunk[-n:]) for m in MARKS)), b"") if chunk else b""
    return Summary(len(_starts(chunk)), any(m in chunk for m in MARKS), tail, chunk[:2])


class Document:
    """A text as chunks with their summaries."""

    def __init__(self, text: bytes, memo: Memo):
        self.text, self.chunks = text, chunks(text)
        self.of = [memo[c] for c in self.chunks]
        self.points = list(accumulate((s.points for s in self.of), initial=0))
        self.n = self.points[-1]

    def marked(self) -> bool:
        """Whether a mark stands in a chunk or over the end of one."""
        over = (a.tail + b.head for a, b in zip(self.of, self.of[1:]) if a.tail)
        return any(s.marked for s in self.of) or any(m in x for x in over for m in MARKS)

    def byte_of(self, point: int) -> int:
        """The byte at which the code point of this number starts (the text's end for its length)."""
        if point >= self.n:
            return len(self.text)
        k = int(np.searchsorted(self.points, point, side="right")) - 1
        return sum(map(len, self.chunks[:k])) + int(_starts(self.chunks[k])[point - self.points[k]])


def rearranged(text: bytes, h: tuple[int, int, int, int], memo: Memo) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and the output for a text and its four numbers."""
    doc = Document(text, memo)
    if not text or h[2] % 100 >= PLAIN_FROM or doc.marked():
        return doc.n, "plain", None, None, text
    a, b = sorted((h[0] % (doc.n + 1), h[1] % (doc.n + 1)))
    p, m = doc.byte_of(a), doc.byte_of(b)
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    pm, sm, mm = MARKS
    if h[3] % 100 < SPM_BELOW:
        return doc.n, "spm", a, b - a, b"".join((sm, suffix, pm, prefix, mm, middle))
    return doc.n, "psm", a, b - a, b"".join((pm, prefix, sm, suffix, mm, middle))


_ADDED = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def fill_in_middle(docs: DataFrame, salt: str = "1:") -> DataFrame:
    """docs plus n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the rearranged text.

    The cuts and the form follow from the sha256 of salt and doc_id alone, so reruns agree and repeated rows come out alike. A null text counts as
    empty, which is plain; a null doc_id counts as an empty string in the hash. Columns of docs by the added names are replaced.
    """
    docs = docs.drop(*_ADDED)
    names = [f"h{k}" for k in range(4)]
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))
    own = docs.columns
    # docs' columns travel as one struct: no name of theirs can clash with the two that stand beside it
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.coalesce("text", F.lit("")).alias("text"), numbers.alias("h"))

    def go(batches):
        memo = Memo(summary, CACHED)
        for b in batches:
            numbers = b.column("h").flatten().to_numpy().reshape(-1, len(names)).tolist()
            made = [rearranged(t, h, memo) for t, h in zip(byte_column(b.column("text")), numbers)]
            n, form, prefix, middle, output = zip(*made) if made else ((),) * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", *_ADDED])

    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), *(T.StructField(c, t) for c, t in _ADDED.items())])
    out = packed.mapInArrow(go, schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in own), *_ADDED)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of that form was made of. Marks never stand in a text that was cut, so the first one of each kind counts."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        a = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(a) + len(second) + 1, F.length(rest))
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substring(rest, F.length(b) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, {', '.join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
