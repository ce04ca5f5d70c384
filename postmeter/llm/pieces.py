"""Encoding and decoding with merge-type piece vocabularies (BPE of the sentencepiece family, with byte fallback).

A text becomes symbols, one for each character; an agenda holds the adjacent pairs whose union is a piece, by score (then the leftmost), and
the best pair is merged until none is left. Symbols that are no piece become their bytes. The agendas of many words stand as rows of one table. No piece has a word mark after another
character, nor a character that stands alone in the vocabulary beside another one: the agenda never joins over such a place, so texts are cut there and each
worker keeps the ids of words that it has met. Words new to a worker go to the library too, in lots, and must come out alike.
"""

from __future__ import annotations

import codecs
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
#: Word mark and the library's stand-in for an unknown id.
MARK, UNKNOWN = "▁", " ⁇ "
#: Words in a worker's cache, the longest word that it keeps, words of a check,
#: characters of texts taken together, words of a table of agendas, and rows of a batch that stand as Python objects at once.
CACHE, LONGEST, CHECKED, TOGETHER, ROWS, SLICE = 300_000, 64, 2_000, 1_000_000, 20_000, 512
#: The rank of a pair that is no piece.
NONE = np.int32(2**31 - 1)
#: Fields of the model file (pieces, trainer, normaliser) and kinds of pieces.
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_NORMAL, _UNK, _CONTROL, _BYTE = 1, 2, 3, 6


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes):
    """(field, value) of a protocol buffer message: whole numbers as int, the rest as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and kinds of a model file. Raises ValueError for models of another type or with other rules than described."""

    def __init__(self, data: bytes):
        self.ids, self.scores, self.kinds, self.texts = {}, [], [], []
        trainer, normaliser = {}, {}
        for field, value in _fields(data):
            if field == _PIECES:
                of = dict(_fields(value))
                text, kind = of.get(1, b"").decode(), of.get(3, _NORMAL)
                if kind == _NORMAL:
                    self.ids[text] = len(self.texts)
                self.texts.append(text)
                self.scores.append(float(np.frombuffer(of.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(kind)
            elif field == _TRAINER:
                trainer = dict(_fields(value))
            elif field == _NORMALISER:
                normaliser = dict(_fields(value))
        plain = normaliser.get(2, b"") == b"" and normaliser.get(4, 1) == 0 and normaliser.get(3, 1) == 1 and normaliser.get(5, 1) == 1
        inner = any(MARK in t.lstrip(MARK) for t in self.ids)
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or not plain or inner or set(self.kinds) - {_NORMAL, _UNK, _CONTROL, _BYTE}:
            raise ValueError("not a merge-type model with byte fallback, a leading word mark and unchanged text")
        self.costs = {t: -self.scores[i] for t, i in self.ids.items()}
        self._index()
        self.byte_ids = [i for i, k in enumerate(self.kinds) if k == _BYTE]
        self.byte_ids.sort(key=lambda i: int(self.texts[i][1:-1], 16))
        if len(self.byte_ids) != 256:
            raise ValueError("a byte has no piece")
        joined = {c for t in self.ids if len(t) > 1 for c in t}
        self.alone = [chr(c) for c in range(128) if chr(c) not in joined and chr(c) != " "]
        alone = regex.escape("".join(self.alone)) or MARK
        #: Words: marks with what follows them, marks alone, and runs of characters that no longer piece has.
        self.words = regex.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]+")

    def _index(self) -> None:
        """Symbols by code point, and for every pair of symbols whose union is a piece the rank of its score and its id."""
        self.symbol = np.full(0x110000, -1, np.int32)
        for t, i in self.ids.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        rank = {c: k for k, c in enumerate(sorted(set(self.costs.values())))}
        pairs = {(self.ids[t[:k]] << 32) | self.ids[t[k:]]: (rank[self.costs[t]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks, self.unions = np.array([(*pairs[k],) for k in self.pairs.tolist()], np.int32).reshape(-1, 2).T.copy()
        self.numbers = list(range(len(self.texts)))  # one object for each id

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the union of pairs of symbols; NONE where it is no piece."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.unions[at]

    def surfaces(self) -> list[bytes]:
        """What each id adds to a decoded text (bytes of a byte piece as they are)."""
        kinds = {_NORMAL: lambda t: t.replace(MARK, " ").encode(), _UNK: lambda t: UNKNOWN.encode(), _CONTROL: lambda t: b"", _BYTE: lambda t: bytes([int(t[1:-1], 16)])}
        return [kinds[k](t) for t, k in zip(self.texts, self.kinds)]


def merged(word: str, vocabulary: Vocabulary) -> tuple[int, ...]:
    """Ids of a word by the agenda: entries are (minus score, place of the left symbol, place of the right one, union). Symbols are a linked
    list, a merged right one is left empty; an entry whose symbols have changed since it was noted is passed over."""
    cost, symbols, end = vocabulary.costs.get, list(word), len(word)
    agenda = []
    for left in range(end - 1):
        union = symbols[left] + symbols[left + 1]
        score = cost(union)
        if score is not None:
            agenda.append((score, left, left + 1, union))
    if agenda:
        heapify(agenda)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while agenda:
            _, left, right, union = heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(union):
                continue
            symbols[left], symbols[right] = union, ""
            following, leading = after[right], before[left]
            after[left] = following
            if following < end:
                before[following] = left
                wider = union + symbols[following]
                score = cost(wider)
                if score is not None:
                    heappush(agenda, (score, left, following, wider))
            if leading >= 0:
                wider = symbols[leading] + union
                score = cost(wider)
                if score is not None:
                    heappush(agenda, (score, leading, left, wider))
    ids, out = vocabulary.ids, []
    for symbol in symbols:
        if symbol:
            k = ids.get(symbol)
            out += [k] if k is not None else [vocabulary.byte_ids[b] for b in symbol.encode()]
    return tuple(out)


def merged_lot(words: list[str], vocabulary: Vocabulary) -> list[tuple[int, ...]]:
    """merged() for many words at once: each row of a table is a word with the ranks of its adjacent pairs, its agenda; a round takes the best
    pair of every row (the leftmost of equals), joins it and ranks the two new pairs. A row without a pair is done."""
    out: list[tuple[int, ...]] = [()] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    low = 0
    for width in (6, 8, 10, 12, 16, 24, 40, LONGEST):
        high = int(np.searchsorted(sizes[order], width, side="right"))
        for at in range(low, high, ROWS):
            some = order[at : min(at + ROWS, high)]
            for k, ids in zip(some.tolist(), _rows([words[k] for k in some.tolist()], sizes[some], width, vocabulary)):
                out[k] = ids
        low = max(low, high)
    for k in order[low:].tolist():
        out[k] = merged(words[k], vocabulary)
    return out


def _rows(words: list[str], sizes: np.ndarray, width: int, vocabulary: Vocabulary) -> list[tuple[int, ...]]:
    n, places = len(words), np.arange(width)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    symbols = np.full((n, width), -1, np.int32)
    symbols[places < sizes[:, None]] = np.where(vocabulary.symbol[points] >= 0, vocabulary.symbol[points], -2 - points.astype(np.int32))
    ranks, unions = vocabulary.joined(symbols[:, :-1], symbols[:, 1:])
    done, left = symbols.copy(), sizes.copy()  # finished rows and how many symbols each has
    rows, count = np.arange(n), sizes.copy()
    while len(rows):
        best = ranks.argmin(axis=1)
        each = np.arange(len(rows))
        ends = ranks[each, best] == NONE
        if ends.any():
            done[rows[ends]], left[rows[ends]] = symbols[ends], count[ends]
            stay = ~ends
            rows, symbols, ranks, unions, count, best = rows[stay], symbols[stay], ranks[stay], unions[stay], count[stay], best[stay]
            each = np.arange(len(rows))
            if not len(rows):
                break
        symbols[each, best] = unions[each, best]
        shift = np.minimum(places + (places > best[:, None]), width - 1)
        symbols = np.take_along_axis(symbols, shift, axis=1)
        symbols[:, -1] = -1
        ranks, unions = (np.take_along_axis(x, np.minimum(shift[:, :-1], width - 2), axis=1) for x in (ranks, unions))
        ranks[:, -1] = NONE
        count -= 1
        ranks[each, best], unions[each, best] = NONE, 0
        for first in (best, best - 1):  # the pairs that the new symbol begins and ends
            some = np.flatnonzero((first >= 0) & (first + 1 < count))
            f = first[some]
            ranks[some, f], unions[some, f] = vocabulary.joined(symbols[some, f], symbols[some, f + 1])
    flat, ends = done[places < left[:, None]], np.cumsum(left)
    foreign, flat = flat < 0, flat.tolist()
    if foreign.any():
        expanded = [[vocabulary.byte_ids[b] for b in chr(-2 - x).encode()] if x < 0 else [x] for x in flat]
        grown = np.cumsum([0, *map(len, expanded)])
        flat, ends = [*chain.from_iterable(expanded)], grown[ends]
    number, ends = vocabulary.numbers.__getitem__, ends.tolist()
    return [tuple(map(number, flat[a:b])) for a, b in zip([0, *ends], ends)]


class Encoder(dict):
    """Words' ids by word, kept up to CACHE words of up to LONGEST characters; words new to it are checked against the library."""

    def __init__(self, vocabulary: Vocabulary, library=None):
        super().__init__()
        self.vocabulary, self.library = vocabulary, library
        self.lines_alone, self[""] = "\n" in vocabulary.alone, ()

    def all_ids(self, texts: list[str | None]):
        """Ids of whole texts, one after another; a word mark stands for every space and before a text. Texts are taken together by their size."""
        lo = size = 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= TOGETHER or k == len(texts) - 1:
                yield from self._some([self.words_of(t) for t in texts[lo : k + 1]])
                lo, size = k + 1, 0

    def words_of(self, text: str | None) -> list[str]:
        """A text's words. Where every space stands by itself, a mark begins each word and line ends are cut off (an empty word has no ids)."""
        if not text:
            return []
        if self.lines_alone and text[0] != " " and "  " not in text and MARK not in text:
            return (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")
        return self.vocabulary.words.findall(MARK + text.replace(" ", MARK))

    def _some(self, lists: list[list[str]]):
        met = set().union(*lists)
        new = list(met.difference(self))
        known = self
        if new:
            found = dict(zip(new, merged_lot(new, self.vocabulary)))
            if self.library:
                self.check(found)
            if len(self) + len(found) > CACHE:
                known = found | {w: self[w] for w in met if w in self}
                self.clear()
                self[""] = ()
            elif any(len(w) > LONGEST for w in new):
                known = self | found
            self.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST)
        for words in lists:
            yield [*chain.from_iterable(map(known.__getitem__, words))]

    def check(self, found: dict[str, tuple[int, ...]]) -> None:
        """Raises RuntimeError if the library encodes a word in another way.

        Words are encoded in lots: those with a mark in one text, which is cut at each mark; those without one each after a character that
        stands alone, as they always do. Runs of marks are tried by themselves. A lot that differs is gone through word by word."""
        alone = "".join(self.vocabulary.alone[:1])
        first = self.library.encode(alone)
        before = tuple(first[1:]) if alone else ()
        marked, bare, runs = [], [], []
        for w in found:
            (bare if w[0] != MARK else marked if w[1:2] not in ("", MARK) else runs).append(w)
        for lo in range(0, len(marked), CHECKED):
            some = marked[lo : lo + CHECKED]
            if self.library.encode("".join(some)[1:].replace(MARK, " ")) != [*chain.from_iterable(map(found.__getitem__, some))]:
                self._hold([(w, found[w], self.library.encode(w[1:])) for w in some])
        for lo in range(0, len(bare), CHECKED):
            some = bare[lo : lo + CHECKED]
            if self.library.encode(alone + alone.join(some)) != [*first[:1], *chain.from_iterable(before + found[w] for w in some)]:
                self._hold([(w, found[w], self.library.encode(alone + w)[len(first) :]) for w in some])
        self._hold([(w, found[w], self.library.encode(w[1:])) for w in runs if w != MARK])

    @staticmethod
    def _hold(cases: list[tuple[str, tuple[int, ...], list[int]]]) -> None:
        for word, ids, theirs in cases:
            if tuple(theirs) != ids:
                raise RuntimeError(f"the library encodes {word[:80]!r} in another way")


#: A worker's encoders by model and check: their words outlive a task.
_ENCODERS: dict[tuple[int, bool], Encoder] = {}


def _encoder(model: bytes, check: bool) -> Encoder:
    key = (xxhash.xxh64_intdigest(model), check)
    if key not in _ENCODERS:
        import sentencepiece

        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model) if check else None)
    return _ENCODERS[key]


def _replaced(error: UnicodeDecodeError):
    return "\ufffd" * (error.end - error.start), error.end


class Decoder:
    """Ids to text: the first piece loses its word mark, bytes that form no character become U+FFFD each."""

    def __init__(self, vocabulary: Vocabulary):
        codecs.register_error("each_byte", _replaced)
        self.surfaces = vocabulary.surfaces()
        self.silent = {i for i, k in enumerate(vocabulary.kinds) if k == _CONTROL}
        self.marked = {i for i, t in enumerate(vocabulary.texts) if vocabulary.kinds[i] == _NORMAL and t.startswith(MARK)}

    def text(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.silent), None)
        if self.silent.isdisjoint(ids):
            out = self._bytes(ids)
        else:  # an id without a surface ends a run of bytes
            ends = [-1, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]
            out = "".join(self._bytes(ids[a + 1 : b]) for a, b in zip(ends, ends[1:]))
        return out[1:] if first in self.marked else out

    def _bytes(self, ids: list[int]) -> str:
        return b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "each_byte")


def _model(docs: DataFrame, path: str):
    """The model's bytes, sent once to each executor (under a megabyte)."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _with(docs: DataFrame, read: str, name: str, kind: T.DataType, go) -> DataFrame:
    """docs plus a column that go makes of batches of the column read. docs' other columns travel as one struct, so no name clashes."""
    docs = docs.drop(name) if read != name else docs
    others = [c for c in docs.columns if c != read]
    packed = docs.select(F.struct(F.lit(1).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("row"), F.col(f"`{read}`").alias("read"))
    schema = T.StructType([*packed.schema.fields, T.StructField("made", kind)])

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *go(b.column("read"))], names=schema.names)

    own = {c: F.col("row").getField(c) for c in others} | {read: F.col("read")} | {name: F.col("made")}
    return packed.mapInArrow(each, schema).select(*(own[c].alias(c) for c in dict.fromkeys([*docs.columns, name])))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", check: bool = True) -> DataFrame:
    """docs plus ids, the list of a whole text's ids as the library at path gives them (no begin or end, no sampling).

    A null or empty text has the empty list; repeated rows are encoded alike; a column of docs named as ids is replaced. With check, each word
    new to a worker is compared with the library, and a difference stops the job.
    """
    model = _model(docs, path or model_path())

    def go(texts):
        encoder = _encoder(model.value, check)
        found = [np.array(ids, np.int32) for lo in range(0, len(texts), SLICE) for ids in encoder.all_ids(texts.slice(lo, SLICE).to_pylist())]
        ends = np.cumsum([0, *map(len, found)])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))

    return _with(docs, text, ids, T.ArrayType(T.IntegerType()), go)


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs plus decoded, the text that the library's decode makes of a list of ids. A null list gives null, an empty one the empty text, a null
    inside a list is skipped, ids outside the vocabulary stop the job; a column of docs named as text is replaced."""
    model = _model(docs, path or model_path())

    def go(lists):
        decoder = Decoder(Vocabulary(model.value))
        values, ends = lists.values, lists.offsets.to_numpy()
        kept = np.asarray(values.is_valid()) & (np.arange(len(values)) >= ends[0]) & (np.arange(len(values)) < ends[-1])
        ids = values.fill_null(0).to_numpy()
        if (ids[kept] < 0).any() or (ids[kept] >= len(decoder.surfaces)).any():
            raise ValueError("an id is not in the vocabulary")
        whole, valid, parts = bool(kept.all()), lists.is_valid().to_numpy(zero_copy_only=False), []
        for lo in range(0, len(lists), SLICE):
            made = []
            for k in range(lo, min(lo + SLICE, len(lists))):
                some = ids[ends[k] : ends[k + 1]]
                made.append(decoder.text((some if whole else some[kept[ends[k] : ends[k + 1]]]).tolist()) if valid[k] else None)
            parts.append(pa.array(made, pa.string()))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return _with(docs, ids, text, T.StringType(), go)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    made = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
