"""Skills named in lists, descriptions and titles: mentions, guarded mentions, provenance, features of a posting.

A taxonomy is a list of Skill rows and a parameter of every operator. Mentions are found by one Arrow function; what becomes of them, the
guard of ambiguous names, containment and order, are higher-order functions over the array of a row, so no posting meets another.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.functions import vocabulary as V
from postmeter.operators.mentions import automaton
from postmeter.operators.text import let, slug

#: Characters around a mention that may hold a skill's own qualifier or a mention beyond doubt; before and after it for general ones; of a snippet.
NEAR, BEFORE, AFTER, ADJACENT, SNIPPET = 60, 40, 30, 12, 25
PATHS = ("source", "text", "title")


class Skill(NamedTuple):
    """A skill. patterns, if given, stand for name and aliases in free text; a guarded name is ordinary English and needs a
    confirmation, of which qualifiers (patterns) are its own; a concept is a method, not a tool."""

    name: str
    category: str
    aliases: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    guarded: bool = False
    qualifiers: tuple[str, ...] = ()
    concept: bool = False

    def pattern(self) -> str:
        def whole(token: str) -> str:
            left = r"\b" if token[0].isalnum() else r"(?<![\w.])"
            right = r"\b" if token[-1].isalnum() else r"(?![\w.])"
            return left + re.escape(token.lower()) + right

        return "|".join(self.patterns or map(whole, (self.name, *self.aliases)))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast("map<string,string>")


def names_of(taxonomy: list[Skill]) -> dict[str, str]:
    """Canonical name by lower-case name, key (blanks as _) and alias; two skills may not claim one string."""
    out: dict[str, str] = {}
    for s in taxonomy:
        for token in (s.name.lower(), re.sub(r"\s+", "_", s.name.strip().lower()), *s.aliases):
            if out.setdefault(token, s.name) != s.name:
                raise ValueError(f"{token!r} is claimed by {out[token]} and {s.name}")
    return out


def concepts(taxonomy: list[Skill]) -> list[str]:
    """Names of methods and practices, as against tools."""
    return [s.name for s in taxonomy if s.concept]


def skill_of(token: Column, taxonomy: list[Skill]) -> Column:
    """Canonical name of a string, or null."""
    return _map(names_of(taxonomy))[F.lower(F.trim(token))]


def _tokens(raw: Column) -> Column:
    low = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda w: F.lower(F.trim(w)))
    return F.filter(low, lambda w: (w != "") & ~w.isin(*V.EXCLUDED_TERMS))


def normalize_list(raw: Column, taxonomy: list[Skill]) -> Column:
    """Canonical names of a list's strings, distinct, in first-seen order; unknown and excluded ones are left out."""
    known = F.transform(_tokens(raw), lambda w: skill_of(w, taxonomy))
    return F.array_distinct(F.filter(known, lambda w: w.isNotNull()))


def unmapped(postings: DataFrame, taxonomy: list[Skill], column: str = "skills_parsed") -> DataFrame:
    """token, n: strings of the lists that the taxonomy does not know; excluded ones are not counted."""
    each = postings.select(F.explode(_tokens(F.col(column))).alias("token"))
    return each.filter(skill_of(F.col("token"), taxonomy).isNull()).groupBy("token").agg(F.count("*").alias("n"))


class Finder:
    """Places of a taxonomy's names in a text: one automaton over all names and aliases, and over the literals of skills with patterns of their
    own, whose regexes run only where such a literal stands. The same places as one regex a skill finds, in one pass."""

    #: Letters that regexes without case take for another one.
    FOLD = str.maketrans({"ſ": "s", "ı": "i"})

    def __init__(self, taxonomy: list[Skill]):
        pairs, self.regexes = [], {}
        for k, s in enumerate(taxonomy):
            if s.patterns:
                self.regexes[k] = re.compile(s.pattern(), re.IGNORECASE)
                pairs += [(literal, (k, None, None, None)) for literal in {anchor(p) for p in s.patterns}]
            else:
                for at, token in enumerate((s.name, *s.aliases)):
                    pairs.append((token.lower(), (k, at, token[0].isalnum(), token[-1].isalnum())))
        self.always = {k for literal, (k, *_) in pairs if not literal}
        self.automaton = automaton((literal, p) for literal, p in pairs if literal)

    def find(self, text: str | None) -> list[dict]:
        if not text:
            return []
        low = text.translate(self.FOLD)
        by_skill: dict[int, list] = {k: [] for k in self.always}
        for last, (n, owners) in self.automaton.iter(low) if self.automaton else ():
            start, end = last + 1 - n, last + 1
            for k, order, left, right in owners:
                if order is None:
                    by_skill.setdefault(k, [])
                elif _free(low, start - 1, left) and _free(low, end, right):
                    by_skill.setdefault(k, []).append((start, order, end))
        out = []
        for k in sorted(by_skill):
            if k in self.regexes:
                out += [{"start": m.start(), "end": m.end(), "skill": k} for m in self.regexes[k].finditer(text)]
                continue
            free = 0  # as alternatives of one regex: the leftmost place, then the first name, and no overlap
            for start, _, end in sorted(by_skill[k]):
                if start >= free:
                    out.append({"start": start, "end": end, "skill": k})
                    free = end
        return out


@functools.lru_cache(maxsize=4)
def _finder(rows: tuple) -> Finder:
    """A worker's finder for a taxonomy."""
    return Finder([Skill(*r) for r in rows])


def _free(text: str, at: int, word: bool) -> bool:
    """Whether the character beside a name leaves it whole; names that end in a sign may not touch a point either."""
    if not 0 <= at < len(text):
        return True
    c = text[at]
    return not (c.isalnum() or c == "_" or (not word and c == "."))


def anchor(pattern: str) -> str:
    """A literal that every match of a pattern holds: the longest run of plain letters outside groups, sets and repeats (empty if there is none)."""
    flat = re.sub(r"\(\?[=!<].*?\)", " ", pattern)
    if "|" in flat:
        return ""
    flat = re.sub(r"\([^()]*\)[?*]|\[[^\]]*\]|\\\w|.[?*]|.\{[^}]*\}", " ", flat)
    return max(re.findall(r"[a-z0-9]+", flat), key=len, default="")


def mentions(text: Column, taxonomy: list[Skill]) -> Column:
    """Every place (start, end, skill number) where a skill's pattern stands in the lower-cased text."""
    rows = tuple(tuple(s) for s in taxonomy)

    # Not a function over batches: those stand in a Python process of their own each, these share one where several texts of a row are read.
    @F.pandas_udf("array<struct<start: int, end: int, skill: int>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(_finder(rows).find)

    return find(F.lower(F.coalesce(text, F.lit(""))))


def audited(text: Column, found: Column, taxonomy: list[Skill]) -> Column:
    """accepted: canonical names in order of place; rejected: (skill, snippet) of ambiguous mentions that nothing confirms.

    A guarded mention counts if a qualifier of its own stands near, if general words before or after it name it a skill, or if it stands
    in a list with a mention beyond doubt near. A mention inside a longer one does not count.
    """
    names = F.array(*(F.lit(s.name) for s in taxonomy))
    guarded = F.array(*(F.lit(s.guarded) for s in taxonomy))
    own = F.array(*(F.lit("(?i)" + "|".join(s.qualifiers) if s.qualifiers else None).cast("string") for s in taxonomy))
    at = lambda array, s: F.get(array, s["skill"])

    def confirmed(low: Column, sure: Column, s: Column) -> Column:
        part = lambda start, end: F.substring(low, F.greatest(start, F.lit(0)) + 1, end - F.greatest(start, F.lit(0)))
        window = part(s["start"] - NEAR, s["end"] + NEAR)
        before, after = part(s["start"] - BEFORE, s["start"]), part(s["end"], s["end"] + AFTER)
        left, right = F.rtrim(before), F.ltrim(part(s["end"], s["end"] + ADJACENT))
        delimiter = f"[{re.escape(V.LIST_DELIMITERS)}]"
        listed = left.rlike(delimiter + "$") | right.rlike("^" + delimiter) | before.rlike(f"(?i){V.LIST_WORDS}") | right.rlike("^(?:and|or) ")
        near = F.exists(sure, lambda o: (o["start"] < s["end"] + NEAR) & (o["end"] > F.greatest(s["start"] - NEAR, F.lit(0))))
        return F.coalesce(F.regexp(window, at(own, s)), F.lit(False)) | before.rlike(f"(?i){V.QUALIFIER_BEFORE}") | after.rlike(f"(?i){V.QUALIFIER_AFTER}") | (listed & near)

    def marked(low: Column, sure: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("shorter"), s["skill"].alias("skill"), s["end"].alias("end"), (~at(guarded, s) | confirmed(low, sure, s)).alias("ok")))

    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["shorter"] != s["shorter"])
    snippet = lambda s: F.trim(F.regexp_replace(F.substring(text, F.greatest(s["start"] - SNIPPET, F.lit(0)) + 1, s["end"] + SNIPPET - F.greatest(s["start"] - SNIPPET, F.lit(0))), r"\s+", " "))

    def told(every: Column, good: Column) -> Column:
        kept = F.array_sort(F.filter(good, lambda s: ~F.exists(good, lambda o: inside(s, o))))
        refused = F.transform(F.filter(every, lambda s: ~s["ok"]), lambda s: F.struct(at(names, s).alias("skill"), snippet(s).alias("snippet")))
        return F.struct(F.array_distinct(F.transform(kept, lambda s: at(names, s))).alias("accepted"), refused.alias("rejected"))

    sure = F.filter(found, lambda s: ~at(guarded, s))
    return let(F.struct(F.lower(text).alias("low"), sure.alias("sure")), lambda x: let(marked(x["low"], x["sure"]), lambda m: let(F.filter(m, lambda s: s["ok"]), lambda g: told(m, g))))


def from_text(postings: DataFrame, text: Column, taxonomy: list[Skill], out: str) -> DataFrame:
    """postings plus out: the audited skills of a text."""
    found = postings.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_found", mentions(F.col("_text"), taxonomy))
    return found.withColumn(out, audited(F.col("_text"), F.col("_found"), taxonomy)).drop("_text", "_found")


def strip_units(title: Column, company: Column, units: dict[str, tuple[str, ...]]) -> Column:
    """A title without the segments that begin with a business unit of its employer; other employers' titles stay as they are."""
    segments = F.filter(F.transform(F.split(title, r"[,/|]|\s[-–]\s"), lambda x: F.trim(x)), lambda x: x != "")
    without = lambda starts: F.array_join(F.filter(segments, lambda x: ~F.lower(x).rlike(starts)), ", ")
    out = F.coalesce(title, F.lit(""))
    for name, own in units.items():
        starts = "^(?:" + "|".join(map(re.escape, own)) + ")"
        out = F.when(F.trim(company) == name, without(starts)).otherwise(out)
    return F.when(title.isNull() | title.rlike(r"^\s*$"), "").otherwise(out)


def merged(source: Column, text: Column, title: Column, taxonomy: list[Skill]) -> Column:
    """The names of three lists by category, then name."""
    rank = _map({s.name: f"{V.SKILL_CATEGORIES.index(s.category):02d}" for s in taxonomy})
    every = F.array_union(F.array_union(source, text), title)
    return F.transform(F.sort_array(F.transform(every, lambda n: F.struct(rank[n].alias("c"), n.alias("n")))), lambda x: x["n"])


def provenance(final: Column, source: Column, text: Column, title: Column) -> dict[str, Column]:
    """skill_provenance and skill_provenance_map: the lists that hold any skill, and those that hold each one."""
    lists = dict(zip(PATHS, (source, text, title)))
    paths = lambda hit: F.concat_ws("+", *(F.when(hit(c), p) for p, c in lists.items()))
    whole = paths(lambda c: F.size(c) > 0)
    return {
        "skill_provenance": F.when(whole == "", "none").otherwise(whole),
        "skill_provenance_map": F.map_from_entries(F.transform(final, lambda n: F.struct(n, paths(lambda c: F.array_contains(c, n))))),
    }


def features(skills: Column, taxonomy: list[Skill]) -> Column:
    """A struct of counts by category, stack and method tags, the leading category and flags of a list of canonical names."""
    category, concept = _map({s.name: s.category for s in taxonomy}), _map(dict.fromkeys(concepts(taxonomy), "1"))

    def told(known: Column, count: Column) -> Column:
        stack = F.filter(known, lambda n: ~category[n].isin(*V.NON_STACK) & concept[n].isNull())
        methods = F.filter(known, lambda n: concept[n].isNotNull())
        of = {c: F.get(count, F.lit(k)) for k, c in enumerate(V.SKILL_CATEGORIES)}
        ranked = F.array(*(F.struct((-n).alias("n"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, (c, n) in enumerate(of.items())))
        named = F.transform(F.filter(ranked, lambda x: x["n"] < 0), lambda x: x["c"])
        out = {
            "skill_count_final": F.size(known),
            "tech_stack_tags": stack,
            "method_tags": methods,
            "n_tech_stack_skills": F.size(stack),
            "n_method_skills": F.size(methods),
            "skill_category_count": F.size(named),
            "skill_categories_final": named,
            **{f"n_skills_{re.sub('[^a-z0-9]+', '_', c.lower()).strip('_')}": n for c, n in of.items()},
            "primary_skill_category": F.when(F.size(named) > 0, F.array_min(ranked)["c"]).otherwise(""),
        }
        flags = {"has_ml_skill": "ML / AI", "has_cloud_skill": "Cloud Platform", "has_programming_skill": "Programming Language", "has_facilities_skill": "Facilities / Data Centre"}
        return F.struct(*(v.alias(k) for k, v in (out | {f: of[c] > 0 for f, c in flags.items()}).items()))

    counts = lambda categories: F.array(*(F.size(F.filter(categories, lambda x: x == c)) for c in V.SKILL_CATEGORIES))  # noqa: E731, B023
    known = F.filter(skills, lambda n: category[n].isNotNull())
    return let(known, lambda k: let(F.transform(k, lambda n: category[n]), lambda own: let(counts(own), lambda count: told(k, count))))


def posting_features(postings: DataFrame, taxonomy: list[Skill], units: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Processed postings plus all skill columns. Reads job_title_clean, cleaned_description, company_canonical and, if there is one, skills_parsed.

    What several columns are made of is a column of its own before them, so it is computed once a row; both texts are looked through by one Python process."""
    c = F.col
    source = c("skills_parsed") if "skills_parsed" in postings.columns else F.array().cast("array<string>")
    title = strip_units(c("job_title_clean"), c("company_canonical"), units or {})
    out = postings.withColumns({"_text": F.coalesce(c("cleaned_description"), F.lit("")), "_title": F.coalesce(title, F.lit(""))})
    out = out.withColumns({"_in_text": mentions(c("_text"), taxonomy), "_in_title": mentions(c("_title"), taxonomy)})
    out = out.withColumns({"_text_skills": audited(c("_text"), c("_in_text"), taxonomy), "_title_skills": audited(c("_title"), c("_in_title"), taxonomy)})
    out = out.withColumns({"skills_source": normalize_list(source, taxonomy), "skills_text": c("_text_skills.accepted"), "skills_title": c("_title_skills.accepted"), "skills_rejected": c("_text_skills.rejected")})
    out = out.drop("_text", "_title", "_in_text", "_in_title", "_text_skills", "_title_skills")
    lists = (c("skills_source"), c("skills_text"), c("skills_title"))
    out = out.withColumn("skills_final", merged(*lists, taxonomy)).withColumns(provenance(c("skills_final"), *lists))
    out = out.withColumn("_features", features(c("skills_final"), taxonomy)).select("*", "_features.*").drop("_features")
    recovered = (F.size("skills_source") == 0) & (F.size("skills_title") > 0)
    return out.withColumns({"has_any_skill": c("skill_count_final") > 0, "skill_recovered_by_title": recovered})


def provenance_rows(featured: DataFrame) -> DataFrame:
    """provenance, rows: postings by the paths that found their skills."""
    return featured.groupBy("skill_provenance").agg(F.count("*").alias("rows"))


def rejected_mentions(featured: DataFrame) -> DataFrame:
    """id, skill, snippet: the ambiguous mentions of descriptions that nothing confirmed."""
    return featured.select("id", F.explode_outer("skills_rejected").alias("r")).filter("r is not null").select("id", "r.*")


def long_table(featured: DataFrame, taxonomy: list[Skill], carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each posting and skill: id, skill, category, slug, is_concept, is_stack, provenance and the carried columns."""
    category, concept = _map({s.name: s.category for s in taxonomy}), _map(dict.fromkeys(concepts(taxonomy), "1"))
    # An inner explode filters by its array's size first, and that filter would be moved below everything that the array is made of and compute it twice.
    each = featured.select("id", F.explode_outer("skills_final").alias("skill"), "skill_provenance_map", *carried).filter("skill is not null")
    is_concept = concept[F.col("skill")].isNotNull()
    return each.select("id", "skill", category[F.col("skill")].alias("category"), slug(category[F.col("skill")]).alias("category_slug"), is_concept.alias("is_concept"), (~is_concept & ~category[F.col("skill")].isin(*V.NON_STACK)).alias("is_stack"), F.col("skill_provenance_map")[F.col("skill")].alias("provenance"), *carried)
