"""Personal data by weak supervision, in DataFrame expressions only.

Patterns name candidate spans. Labelers vote on each (for, against, or not at all): its own check, its shape, gazetteers, the words
before it, its variety, its neighbours. Spans with equal votes are counted together over all documents; on that bounded table
expectation-maximisation runs until it settles and estimates how often each labeler casts each vote on true and on false candidates.
Numbers that look like addresses or cards but fail their check take part, as the false class would else have no members. A logistic
classifier of what a span looks like and of the word before it, none of them a vote, learns from the estimated truth. Spans of the four
base kinds that pass their own checks stay whatever the classifier says; of the other kinds it takes those that it finds likelier than not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.llm.common import ROW, durable, let, set_aside

_LOCAL = "A-Za-z0-9._%+-"
#: Kinds in order; base kinds first. Matches are leftmost and don't overlap within a kind: they start where a run
#: starts or the last match ended, and possessive quantifiers keep long runs linear.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+(?![A-Za-z0-9+/_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "spelled_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]?(?: at |@)[\])]? ?[a-z0-9-]++(?: dot [a-z]{2,}+)++(?![a-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Cheap tests that a text with a match always passes.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None, "iban": None, "ssn": "-", "local_phone": None, "spelled_email": " dot "}
#: Gazetteer entries and words of the context, for and against.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info|biz|eu|us)$",
    "ip": r"^(?!0\.|255\.)(?:10\.|172\.|192\.|[1-9])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:sk|pk|ghp|gho|xox[bp]|AKIA)[A-Za-z0-9_-]+$",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "ssn": r"^(?!000|666|9)",
    "local_phone": r"^\(?[2-9]",
    "spelled_email": r"(?i) dot (?:com|org|net|edu|gov|io|de|fr|es|uk)$",
}
FOR_WORDS = r"(?i)(?:e-?mail|mail|contact|write to|tel|phone|call|fax|mobile|ip|host|address|server|card|visa|iban|account|ssn|social security|token|secret|key|password|passwd|api)[\s\"':=#(]*$"
AGAINST_WORDS = r"(?i)(?:version|release|isbn|issn|order|page|section|figure|table|doi|commit|sha|sha1|sha256|md5|checksum|digest|hash|revision|chapter|no\.)[\s\"':=#(]*$"
CONTEXT = 24
LABELERS = ("check", "shape", "gazetteer", "context", "variety", "edges")
#: Kinds with a check of their own; for other kinds that labeler has no say, which tells nothing of their truth.
CHECKED = tuple(KINDS.index(k) for k in ("ip", "card", "iban", "ssn"))
#: What the classifier sees of a span, and how many values each has: kind, length, distinct characters, digits, mixed case, the word before.
FEATURES = {"kind": len(KINDS), "length": 5, "distinct": 3, "digits": 3, "mixed": 2, "before": 33}
#: Expectation-maximisation and training end when no value moves by more than this, or after so many rounds.
SETTLED, ROUNDS, STEPS = 1e-6, 500, 2_000
#: Share of true candidates before any is seen, and for how many candidates this belief stands.
PRIOR, PRIOR_WEIGHT = 0.6, 4.0
#: Bounds of that share: within them one vote against outweighs it.
PRIOR_BOUNDS = (0.5, 0.7)
#: How much likelier a vote against is on a false candidate than on a true one, at least.
AGAINST = 3.0


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _iban_sum(match: Column) -> Column:
    """Remainder by 97 of an IBAN's digits, four characters moved to the end, letters counted from 10."""
    plain = F.upper(F.replace(match, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(total: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _passes(kind: str, match: Column) -> Column:
    """A kind's own check of a match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    if kind == "iban":
        return _iban_sum(match) == 1
    if kind == "ssn":
        return match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    return F.lit(True)


def _considered(kind: str, match: Column, ok: Column) -> Column:
    """Whether a match is a candidate: one that passes, or one that a check alone tells from a true one."""
    if kind in ("ip", "iban", "ssn"):
        return F.lit(True)
    if kind == "card":
        n = F.length(F.regexp_replace(match, "[^0-9]", ""))
        return (n >= 12) & (n <= 19)
    return ok


def _spans(text: Column, kind: str) -> Column:
    """(start, end, kind, match, ok) of the kind's candidates; ok: the match passes its check. Code points from 0, end exclusive."""
    pattern = PATTERNS[kind]
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, kind: int, match: string, ok: boolean>>)")

    def place(pieces: Column, matches: Column) -> Column:
        def measured(m: Column, i: Column) -> Column:
            ok = _passes(kind, m)
            return F.struct(F.length(F.get(pieces, i)).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("match"), ok.alias("ok"), _considered(kind, m, ok).alias("use"))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["match"].alias("match"), x["ok"].alias("ok"))
            return F.struct((start + x["size"]).alias("at"), F.when(x["use"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(F.transform(matches, measured), F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])

    found = let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: place(pieces, matches)))
    gate = text.rlike("[0-9][ -]?(?:[0-9][ -]?){10}[0-9]") if kind == "card" else text.rlike(pattern)
    if GATES[kind] and kind not in ("secret", "iban"):
        gate = F.contains(text, F.lit(GATES[kind])) & gate
    return F.when(gate, found).otherwise(none)


def _votes(text: Column, span: Column, before: Column) -> list[Column]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 undecided."""
    match, kind = span["match"], span["kind"]
    around = F.concat(F.when(span["start"] > 0, F.substring(text, span["start"].cast("int"), 1)).otherwise(F.lit(" ")), F.lit("x"), F.substring(text, (span["end"] + 1).cast("int"), 1))
    listed = F.lit(False)
    for k, pattern in enumerate(GAZETTEER.values()):
        listed = F.when(kind == k, match.rlike(pattern)).otherwise(listed)
    secret, phones = kind == KINDS.index("secret"), kind.isin(KINDS.index("phone"), KINDS.index("local_phone"))
    shaped = F.when(secret, match.rlike("[0-9].*[0-9].*[0-9]")).when(phones, match.rlike("[ ().-]")).otherwise(F.lit(True))
    checked = kind.isin(*CHECKED)
    plain = F.regexp_replace(match, "[^A-Za-z0-9]", "")
    return [
        F.when(~checked, 0).when(span["ok"], 1).otherwise(-1),
        F.when(shaped, 1).otherwise(-1),
        F.when(listed, 1).otherwise(0),
        F.when(before.rlike(FOR_WORDS), 1).when(before.rlike(AGAINST_WORDS), -1).otherwise(0),
        F.when(F.size(F.array_distinct(F.split(plain, ""))) <= 3, -1).otherwise(0),
        F.when(around.rlike(r"^[\p{L}\p{N}]|[\p{L}\p{N}]$"), -1).otherwise(1),
    ]


def _looks(span: Column, before: Column) -> list[Column]:
    """The classifier's features of a span, each a number from 0 below its count in FEATURES."""
    match = span["match"]
    size = F.length(match)
    plain = F.regexp_replace(match, "[^A-Za-z0-9]", "")
    n = F.greatest(F.length(plain), F.lit(1))
    distinct = F.size(F.array_distinct(F.split(plain, ""))) / F.least(n, F.lit(36))
    digits = F.length(F.regexp_replace(plain, "[^0-9]", "")) / n
    word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    return [
        span["kind"],
        F.when(size < 12, 0).when(size < 24, 1).when(size < 40, 2).when(size <= 64, 3).otherwise(4),
        F.when(distinct < 0.2, 0).when(distinct < 0.4, 1).otherwise(2),
        F.when(digits < 0.2, 0).when(digits < 0.6, 1).otherwise(2),
        F.when(match.rlike("[a-z]") & match.rlike("[A-Z]"), 1).otherwise(0),
        F.when(word == "", 0).otherwise(1 + F.pmod(F.crc32(word.cast("binary")), F.lit(FEATURES["before"] - 1)).cast("int")),
    ]


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs plus `_spans`: candidate spans of all kinds with their votes and features, by start and then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.concat(*(_spans(text, k) for k in KINDS))

    def judged(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        votes = [v.cast("int").alias(f"v_{n}") for n, v in zip(LABELERS, _votes(text, s, before))]
        looks = [v.cast("int").alias(f"f_{n}") for n, v in zip(FEATURES, _looks(s, before))]
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["ok"].alias("ok"), *votes, *looks)

    return docs.withColumn("_spans", F.sort_array(F.transform(spans, judged)))


def vote_table(candidates: DataFrame) -> DataFrame:
    """Candidates counted by votes and features: bounded by the number of their combinations, whatever the input."""
    each = candidates.select(F.explode("_spans").alias("s")).select("s.*")
    return durable(each.groupBy(*(f"v_{n}" for n in LABELERS), *(f"f_{n}" for n in FEATURES)).agg(F.count("*").cast("double").alias("n")))


class Reliabilities:
    """How often each labeler casts each vote (against, none, for) on true and on false candidates of a kind, and each kind's share of true ones.

    Rates lean on the kind's votes as a whole, so a labeler that votes alike on all candidates of a kind tells nothing there. Which of two
    classes is the true one, votes alone cannot settle; two assumptions do: a vote for never speaks against a candidate, and a vote
    against speaks against it at least AGAINST times."""

    def __init__(self, rows: list[tuple[int, tuple[int, ...], float]]):
        """rows: (kind, votes, count). Runs until no estimated truth moves by more than SETTLED.

        It starts from the votes' sum, in which a kind's own check weighs three times."""
        kinds = sorted({k for k, _, _ in rows})
        truth = [self._logistic(sum(v) + 2 * v[0]) for _, v, _ in rows]
        self.rounds = 0
        while self.rounds < ROUNDS:
            self.rounds += 1
            self.prior, self.rates = {}, {}
            for kind in kinds:
                votes = [(v, n, p) for (k, v, n), p in zip(rows, truth) if k == kind]
                share = (sum(n * p for _, n, p in votes) + PRIOR * PRIOR_WEIGHT) / (sum(n for _, n, _ in votes) + PRIOR_WEIGHT)
                self.prior[kind] = min(max(share, PRIOR_BOUNDS[0]), PRIOR_BOUNDS[1])
                self.rates[kind] = [self._rates(k, votes) for k in range(len(LABELERS))]
            new = [self.truth(kind, v) for kind, v, _ in rows]
            moved = max((abs(a - b) for a, b in zip(new, truth)), default=0.0)
            truth = new
            if moved < SETTLED:
                break

    @staticmethod
    def _rates(k: int, votes) -> dict[bool, list[float]]:
        """Shares of votes against, none and for among true and among false candidates."""
        counts = {True: [0.0] * 3, False: [0.0] * 3}
        for v, n, p in votes:
            counts[True][v[k] + 1] += n * p
            counts[False][v[k] + 1] += n * (1 - p)
        total = sum(n for _, n, _ in votes)
        whole = [(a + b + 0.1) / (total + 0.3) for a, b in zip(counts[True], counts[False])]
        leaning = {c: [x + PRIOR_WEIGHT * w for x, w in zip(xs, whole)] for c, xs in counts.items()}
        return {c: [x / sum(xs) for x in xs] for c, xs in leaning.items()}

    @staticmethod
    def _logistic(z: float) -> float:
        return 1 / (1 + math.exp(-max(min(z, 40.0), -40.0)))

    def truth(self, kind: int, votes: tuple[int, ...]) -> float:
        """The probability that a candidate with these votes is true."""
        z = math.log(self.prior[kind] / (1 - self.prior[kind]))
        for rate, v in zip(self.rates[kind], votes):
            odds = math.log(rate[True][v + 1] / rate[False][v + 1])
            z += min(odds, -math.log(AGAINST)) if v < 0 else max(odds, 0.0) if v > 0 else odds
        return self._logistic(z)


class SpanClassifier:
    """A weight for each value of each feature, and a constant: logistic regression on estimated truths."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]], decay: float = 0.05):
        """rows: (features, count, truth). Plain ascent, each weight's step divided by how often its value occurs."""
        self.constant, self.weights = 0.0, [[0.0] * size for size in FEATURES.values()]
        total = sum(n for _, n, _ in rows)
        seen = [[0.0] * size for size in FEATURES.values()]
        for f, n, _ in rows:
            for k, x in enumerate(f):
                seen[k][x] += n
        parts = len(FEATURES) + 1
        for _ in range(STEPS if rows else 0):
            slope, slopes = 0.0, [[0.0] * size for size in FEATURES.values()]
            for f, n, p in rows:
                e = n * (p - Reliabilities._logistic(self.logit(f)))
                slope += e
                for k, x in enumerate(f):
                    slopes[k][x] += e
            moved = abs(slope) * 4 / parts / total
            self.constant += slope * 4 / parts / total
            for own, gs, ns in zip(self.weights, slopes, seen):
                for x, (g, n) in enumerate(zip(gs, ns)):
                    if n:
                        step = (g - decay * own[x]) * 4 / parts / (n + decay)
                        own[x] += step
                        moved = max(moved, abs(step))
            if moved < 1e-4:
                break

    def logit(self, features: tuple[int, ...]) -> float:
        return self.constant + sum(w[x] for w, x in zip(self.weights, features))

    def column(self, span: Column) -> Column:
        """The logit of a span of `_spans`."""
        z = F.lit(self.constant)
        for name, w in zip(FEATURES, self.weights):
            z = z + F.element_at(F.array(*map(F.lit, w)), span[f"f_{name}"] + 1)
        return z


def learn(votes: DataFrame) -> tuple[Reliabilities, SpanClassifier]:
    """Both models from a vote table, whose sums by kind and votes, then by features, have a bounded number of rows."""
    cast = [f"v_{n}" for n in LABELERS]
    by_votes = votes.groupBy("f_kind", *cast).agg(F.sum("n")).orderBy("f_kind", *cast).collect()
    reliable = Reliabilities([(r[0], tuple(r[1:-1]), r[-1]) for r in by_votes])
    known = {(r[0], *r[1:-1]): reliable.truth(r[0], tuple(r[1:-1])) for r in by_votes}
    looks = [f"f_{n}" for n in FEATURES]
    truth = F.create_map(*(F.lit(x) for k, p in known.items() for x in (",".join(map(str, k)), p))) if known else F.create_map(F.lit(""), F.lit(0.0))
    p = F.coalesce(truth[F.concat_ws(",", *(F.col(c).cast("string") for c in ("f_kind", *cast)))], F.lit(0.5))
    by_looks = votes.groupBy(*looks).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * p) / F.sum("n")).alias("p")).orderBy(*looks).collect()
    return reliable, SpanClassifier([(tuple(r[:-2]), r[-2], r[-1]) for r in by_looks])


def _chosen(model: SpanClassifier) -> Column:
    """Of `_spans` the base ones that pass their checks and those others that the classifier takes."""
    return F.filter("_spans", lambda s: F.when(s["kind"] < len(BASE), s["ok"]).otherwise(model.column(s) >= 0))


def _stated(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_found(lean: DataFrame) -> DataFrame:
    """The rows' own columns and `found`. Candidates are written once, as a table, and read for the votes and again for the result."""
    candidates = durable(with_candidates(lean).select(ROW, "_spans"))
    _, model = learn(vote_table(candidates))
    return candidates.select(ROW, F.transform(_chosen(model), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("found"))


def find(docs: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """docs plus n_email, n_ip, n_card, n_phone, base_sha256, spans and found (start, kind, end of every span taken).

    kept: columns of docs to return; all if not given. Null and empty texts have no spans (base_sha256 is that of the empty
    string). Texts are searched whole; repeated rows are judged alike; spans of different kinds may overlap. Columns of docs by the
    added names are replaced.
    """
    docs, own = set_aside(docs.drop(*ADDED), "text", kept=kept)
    out = _with_found(docs)
    base = lambda s: s["kind"] < len(BASE)
    of_kind = F.transform("found", lambda s: s["kind"])
    counts = {f"n_{k}": (F.size(of_kind) - F.size(F.array_remove(of_kind, KINDS.index(k)))).cast("long") for k in BASE}
    return out.select(*own, *(n.alias(c) for c, n in counts.items()), F.sha2(_stated(F.filter("found", base)), 256).alias("base_sha256"), _stated(F.col("found")).alias("spans"), "found")


ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found")


def redact(docs: DataFrame) -> DataFrame:
    """docs, with each span found replaced by its kind in angle brackets; of spans that overlap the first one's mark stands for all.

    Texts without spans, null ones too, stay as they are; n_chars, if docs has it, follows the text where it changed.
    """
    names = docs.columns
    lean, own = set_aside(docs, "text")
    text = F.col(ROW).getField("text")

    def cut(acc: Column, s: Column) -> Column:
        mark = F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit(">"))
        between = F.substring(text, (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int"))
        parts = F.when(s["start"] >= acc["upto"], F.array_append(F.array_append(acc["parts"], between), mark)).otherwise(acc["parts"])
        return F.struct(F.greatest(s["end"], acc["upto"]).alias("upto"), parts.alias("parts"))

    start = F.struct(F.lit(0).cast("long").alias("upto"), F.expr("cast(array() as array<string>)").alias("parts"))
    finish = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["upto"] + 1).cast("int"), F.length(text)))
    some = F.size("found") > 0
    out = _with_found(lean).withColumn("clean", F.when(some, F.aggregate("found", start, cut, finish)).otherwise(text))
    restored = dict(zip(names, own)) | {"text": F.col("clean").alias("text")}
    if "n_chars" in names:
        restored["n_chars"] = F.when(some, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(ROW).getField("n_chars")).alias("n_chars")
    return out.select(*(restored[c] for c in names))
