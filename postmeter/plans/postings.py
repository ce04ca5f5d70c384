"""Raw postings: cleaning, rule ladders, employers, skills."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from postmeter import roles
from postmeter.functions import vocabulary as V
from postmeter.functions.taxonomy import taxonomy
from postmeter.operators import skills, text
from postmeter.operators.skills import Skill
from postmeter.plans.registry import query
from postmeter.sources import company_set
from postmeter.sources.tables import checkpoint_folder, remove, settled

_case = lambda m, c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


def _nth(forms, key: str, *args: str) -> str:
    out = []
    for f in forms:
        pieces, used = f.split("{}"), list(args)
        expr = [f"'{pieces[0]}'"]
        for p in pieces[1:]:
            expr += [used.pop(0), f"'{p}'"]
        out.append("(" + " || ".join(expr) + ")")
    return f"[{', '.join(out)}][CAST({key} % {len(forms)} + 1 AS INT)]"


NAMED = "named AS (SELECT id, list_sort(list(item)) AS names, list_sort(list(DISTINCT item_group)) AS groups FROM (SELECT DISTINCT l_orderkey AS id, p_name AS item, split_part(p_name, ' ', 2) AS item_group FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1)"
#: Common table expressions of roles.order_texts.
TEXTS = f"""{NAMED}, raw0 AS (SELECT o_orderkey AS id, {_case(roles.LEVELS, 'o_orderpriority')} || {_case(roles.ROLES, 'c_mktsegment')} || {_case(roles.ENDINGS, 'o_orderstatus')} AS job_title,
 {_nth(roles.EMPLOYERS, 'c_custkey', 'n_name')} AS company_name, {_nth(roles.PLACES, 'o_orderkey', 'n_name', 'r_name')} AS location, strftime(o_orderdate, '%Y-%m-%d') AS posting_date,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'Internship' ELSE 'Full-time' END AS employment_type
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (SELECT raw0.*, names, groups FROM raw0 LEFT JOIN named USING (id))"""


def ladder_sql(rules, column: str, otherwise: str, blank: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{n}'" for n, p in rules)
    return f"CASE WHEN coalesce(trim({column}), '') = '' THEN '{blank}' {whens} ELSE '{otherwise}' END"


def _trim(c: str) -> str:
    return rf"trim({c}, ' ,-')"


_SQUEEZED = r"regexp_replace({0}, '\s+', ' ', 'g')"
TITLES = rf"""
title_clean AS (SELECT id, {_trim(r"regexp_replace(" + _trim(_SQUEEZED.format('job_title')) + r", '(?:,\s*|\s+)(?:(?:summer|fall|winter|spring)\s*/?\s*)?[0-9]{4}\s*$', '', 'i')")} AS job_title_clean FROM raw),
titles AS (SELECT id, {ladder_sql(V.SENIORITY, 'job_title', 'Mid', 'Unknown')} AS level, coalesce(regexp_extract(job_title, '(?:^|[^A-Za-z])(IV|III|II|I)(?:[^A-Za-z]|$)', 1), '') AS level_marker,
 CASE WHEN NOT regexp_matches(job_title, '\bmanager\b', 'i') THEN '' WHEN regexp_matches(job_title, '{V.IC_MANAGER}', 'i') THEN 'ic_manager_title' ELSE 'people_manager' END AS manager_type,
 {ladder_sql(V.CATEGORIES, 'job_title', 'Other', 'Unknown')} AS job_category, {ladder_sql(V.FUNCTIONS, 'job_title', 'Other', 'Unknown')} AS job_function, job_title_clean,
 regexp_matches(job_title, '(\.\.\.|…)\s*$') OR NOT regexp_matches(job_title, '{V.ROLE_NOUNS}', 'i') OR lower(job_title) = job_title AS title_suspect FROM raw JOIN title_clean USING (id))"""


def _texts(spark, d):
    return roles.order_texts(spark, d)


@query("text_titles", f"WITH {TEXTS}, {TITLES} SELECT * FROM titles")
def titles(spark, d):
    t = F.col("job_title")
    s = text.seniority(t)
    return _texts(spark, d).select("id", s["level"].alias("level"), s["level_marker"].alias("level_marker"), s["manager_type"].alias("manager_type"), text.category_of(t).alias("job_category"), text.function_of(t).alias("job_function"), text.clean_title(t).alias("job_title_clean"), text.title_suspect(t).alias("title_suspect"))


_BRAND = " ".join(f"WHEN regexp_matches(name, '{p}', 'i') THEN '{b}'" for b, p in V.BRANDS)
COMPANIES = rf"""
named_c AS (SELECT id, {_trim(_SQUEEZED.format('company_name'))} AS name FROM raw),
companies AS (SELECT id, coalesce(brand, name) AS canonical, brand IS NOT NULL AS is_group, regexp_matches(name, '{V.LEAKED_ROLE}', 'i') AND contains(name, ',') AS field_suspect
 FROM (SELECT *, CASE WHEN regexp_matches(name, '{V.THIRD_PARTY}', 'i') THEN NULL {_BRAND} END AS brand FROM named_c))"""


@query("text_companies", f"WITH {TEXTS}, {COMPANIES} SELECT * FROM companies")
def companies(spark, d):
    return _texts(spark, d).select("id", text.company(F.col("company_name")).alias("c")).select("id", "c.*")


_SUFFIXES = sorted(V.COUNTRY_SUFFIXES, key=len, reverse=True)
_STATES = ", ".join(f"'{s}'" for s in V.US_STATES)
_ALIASES = " ".join(f"WHEN lower(last) = '{k}' THEN '{v}'" for k, v in V.COUNTRY_ALIASES.items())
_ENDS = " ".join(f"WHEN ends_with(lower(last), '{s.lower()}') THEN '{s}'" for s in _SUFFIXES)
_BEFORE = " ".join(f"WHEN ends_with(lower(last), '{s.lower()}') THEN {_trim(f'left(last, length(last) - {len(s)})')}" for s in _SUFFIXES)
PLACED = rf"""
p0 AS (SELECT id, trim({_SQUEEZED.format('location')}) AS clean FROM raw),
p1 AS (SELECT *, regexp_matches(clean, '{V.REMOTE}', 'i') AS is_remote, regexp_replace(clean, '\s*\(\+\s*[0-9]+\s+others?\s*\)\s*$', '', 'i') AS stripped FROM p0),
p2 AS (SELECT *, list_filter(list_transform(string_split(replace(stripped, ' - ', ', '), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM p1),
p3 AS (SELECT *, len(parts) AS n, parts[len(parts)] AS last, coalesce(upper(parts[len(parts)]) IN ({_STATES}), FALSE) AS state, is_remote OR len(parts) = 0 AS none FROM p2),
places AS (SELECT id, CASE WHEN none THEN '' WHEN n >= 2 THEN parts[1] WHEN state THEN '' ELSE CASE {_BEFORE} ELSE '' END END AS city,
 CASE WHEN none THEN '' WHEN state THEN upper(last) WHEN n >= 3 THEN parts[2] ELSE '' END AS region, CASE WHEN none THEN '' WHEN state THEN 'United States' ELSE CASE {_ENDS} {_ALIASES} ELSE last END END AS country,
 is_remote, NOT is_remote AND stripped <> clean AS is_multi, clean FROM p3)"""


@query("text_locations", f"WITH {TEXTS}, {PLACED} SELECT * FROM places")
def locations(spark, d):
    return _texts(spark, d).select("id", text.location(F.col("location")).alias("p")).select("id", "p.*")


@query("text_skill_lists", f"WITH {TEXTS} SELECT id, coalesce(array_to_string(groups, ','), '') AS listed, coalesce('parts=' || array_to_string(groups, ','), '') AS categories FROM raw")
def skill_lists(spark, d):
    c = text.parse_categories(F.col("skill_categories"))
    stated = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return _texts(spark, d).select("id", F.array_join(text.parse_list(F.col("extracted_skills")), ",").alias("listed"), F.array_join(stated, ";").alias("categories"))


CLEANED = "CASE WHEN names IS NULL THEN '' ELSE 'Experience with ' || array_to_string(names, ', ') || ' & more work.' END"
PROCESSED = rf"""{TITLES}, {COMPANIES}, {PLACED},
processed AS (SELECT raw.*, t.* EXCLUDE (id), c.* EXCLUDE (id), p.* EXCLUDE (id, clean), p.clean AS location_clean, {CLEANED} AS cleaned, CAST(posting_date AS DATE) AS day
 FROM raw JOIN titles t ON t.id = raw.id JOIN companies c ON c.id = raw.id JOIN places p ON p.id = raw.id)"""


@query(
    "text_preprocess",
    f"""WITH {TEXTS}, {PROCESSED} SELECT id, canonical AS company_canonical, level AS seniority_level, country AS location_country, strftime(day, '%Y-%m') AS posting_month, strftime(day, '%G-W%V') AS posting_week,
 year(day) || '-Q' || quarter(day) AS posting_quarter, dayname(day) AS posting_dow, job_title_clean, cleaned AS cleaned_description, coalesce(len(groups), 0) AS skill_count, level = 'Intern' OR employment_type = 'Internship' AS is_internship FROM processed""",
)
def preprocess(spark, d):
    out = text.preprocess(_texts(spark, d))
    return out.select("id", "company_canonical", "seniority_level", "location_country", "posting_month", "posting_week", "posting_quarter", "posting_dow", "job_title_clean", "cleaned_description", "skill_count", "is_internship")


_FLAGS = {"rows_in": "TRUE", "rows_in_group": "is_group", "rows_excluded": "NOT is_group", "company_field_suspect_rows": "field_suspect", "rows_with_description": "cleaned <> ''", "rows_missing_location": "location_clean = ''", "rows_remote": "is_remote", "rows_multi_location": "is_multi", "title_suspect_rows": "title_suspect", "rows_with_skills": "coalesce(len(groups), 0) > 0"}
_DIMS = {"company_canonical": "canonical", "job_category": "job_category", "job_function": "job_function", "seniority_level": "level"}
QUALITY = " UNION ALL ".join([f"SELECT '{k}' AS check, '' AS value, count(*) FILTER ({v}) AS n FROM processed" for k, v in _FLAGS.items()] + [f"SELECT '{k}', {v}, count(*) FROM processed GROUP BY ALL" for k, v in _DIMS.items()])
QUALITY += " UNION ALL SELECT 'excluded_company', company_name, count(*) FROM processed WHERE NOT is_group GROUP BY ALL"
QUALITY += " UNION ALL SELECT * FROM (SELECT 'location_country', country, count(*) AS n FROM processed WHERE country <> '' GROUP BY ALL ORDER BY n DESC, country LIMIT 15)"


@query("text_quality_report", f"WITH {TEXTS}, {PROCESSED} {QUALITY}")
def quality_report(spark, d):
    return text.quality_report(text.preprocess(_texts(spark, d)))


#: Employer families for the given tables: key, include, exclude, brands.
FAMILIES = [("google", r"google|waymo", r"premier partner", [("Waymo", r"\bwaymo\b"), ("Google", r"\bgoogle\b")]), ("bolt", r"\bbolt\b", "", [("Red Bolt", r"red\s+bolt")]), ("gear", r"\bgear\b", "", [("Old Gear", "old gear")])]


def rules(spark):
    """The dimension table of employer families."""
    return spark.createDataFrame(FAMILIES, "key string, include string, exclude string, brands array<struct<brand: string, pattern: string>>")


_INCLUDE = "CASE key " + " ".join(f"WHEN '{k}' THEN regexp_matches(name, '{i}', 'i')" for k, i, *_ in FAMILIES) + " END"
_EXCLUDE = "CASE key " + " ".join(f"WHEN '{k}' THEN regexp_matches(name, '{x}', 'i')" for k, _, x, _ in FAMILIES if x) + " ELSE FALSE END"
_BRANDED = "CASE " + " ".join(f"WHEN key = '{k}' AND regexp_matches(name, '{p}', 'i') THEN '{b}'" for k, _, _, bs in FAMILIES for b, p in bs) + " ELSE '' END"
AUDIT = rf"""
nm AS (SELECT company_name AS name, count(*) AS n FROM raw GROUP BY 1), hits AS (SELECT k.key, nm.* FROM nm, (VALUES {', '.join(f"('{k}')" for k, *_ in FAMILIES)}) k(key) WHERE {_INCLUDE}),
audit AS (SELECT key, name, n, CASE WHEN contains(name, ',') AND regexp_matches(name, '{V.EMPLOYER_ROLE}', 'i') THEN 'role_string' WHEN {_EXCLUDE} THEN 'named_third_party' WHEN regexp_matches(name, '{V.AGENCY}', 'i') THEN 'third_party_marker' ELSE '' END AS reason, {_BRANDED} AS b FROM hits)"""


@query("text_employer_audit", f"WITH {TEXTS}, {AUDIT} SELECT key AS company, name AS employer_string, n AS postings, CASE WHEN reason = '' THEN 'matched' ELSE 'excluded' END AS decision, CASE WHEN reason = '' THEN b ELSE '' END AS brand, reason FROM audit")
def employer_audit(spark, d):
    return text.matching_audit(_texts(spark, d), rules(spark))


@query("text_resolved_employers", f"WITH {TEXTS}, {AUDIT} SELECT id, key AS company_key, b AS company_brand FROM raw JOIN audit ON name = company_name WHERE reason = ''")
def resolved(spark, d):
    return text.resolve_employers(_texts(spark, d), rules(spark)).select("id", "company_key", "company_brand")


@query("text_selected_employer", f"WITH {TEXTS}, {AUDIT} SELECT id, b AS company_brand FROM raw JOIN audit ON name = company_name WHERE reason = '' AND key = 'google'")
def selected(spark, d):
    return text.select_company(_texts(spark, d), rules(spark), "google").select("id", "company_brand")


#: A taxonomy for the given tables: nouns and colours of part names.
TAXONOMY = [
    Skill("Gear", "Programming Language"), Skill("Bolt", "Cloud Platform", ("bolts",)), Skill("Small Gear", "ML / AI"), Skill("Plate", "Database", concept=True),
    Skill("Hot", "Analytics / BI", guarded=True, qualifiers=(r"\bhot pipe",)), Skill("Red", "DevOps / Infrastructure", guarded=True), Skill("Widget", "Office / Productivity"),
    Skill("Google Cloud", "Cloud Platform"), Skill("Machine Learning", "ML / AI", ("ml",), concept=True),
]
UNITS = {"Google": ("google cloud",)}


@query("skills_from_lists", f"WITH {TEXTS}, w AS (SELECT id, unnest(groups) AS w FROM raw) SELECT id, string_agg(CASE w WHEN 'gear' THEN 'Gear' WHEN 'bolt' THEN 'Bolt' WHEN 'plate' THEN 'Plate' WHEN 'widget' THEN 'Widget' END, ',' ORDER BY w) AS skills FROM w WHERE w IN ('gear', 'bolt', 'plate', 'widget') GROUP BY 1")
def from_lists(spark, d):
    named = text.parse_list(F.col("extracted_skills"))
    return _texts(spark, d).select("id", F.array_join(skills.normalize_list(named, TAXONOMY), ",").alias("skills")).filter("skills <> ''")


@query("skills_unmapped", f"WITH {TEXTS} SELECT w AS token, count(*) AS n FROM (SELECT unnest(groups) AS w FROM raw) WHERE w NOT IN ('gear', 'bolt', 'plate', 'widget') GROUP BY 1")
def unmapped(spark, d):
    p = _texts(spark, d).withColumn("skills_parsed", text.parse_list(F.col("extracted_skills")))
    return skills.unmapped(p, TAXONOMY)


def featured(spark, d):
    return skills.posting_features(text.preprocess(_texts(spark, d)), TAXONOMY, UNITS)


@query("skills_of_postings")
def of_postings(spark, d):
    f = featured(spark, d)
    return f.select("id", *(F.array_join(c, ",").alias(c) for c in ("skills_source", "skills_text", "skills_title", "skills_final", "tech_stack_tags", "method_tags")), "skill_provenance", "skill_count_final", "n_skills_cloud_platform", "n_skills_ml_ai", "primary_skill_category", "has_ml_skill", "has_any_skill", "skill_recovered_by_title")


@query("skills_rejected_mentions")
def rejected(spark, d):
    return skills.rejected_mentions(featured(spark, d))


@query("skills_provenance_rows")
def provenance(spark, d):
    return skills.provenance_rows(featured(spark, d))


@query("skills_long_table")
def long_table(spark, d):
    return skills.long_table(featured(spark, d), TAXONOMY, ("posting_month", "seniority_level"))


@query("skills_title_segments", f"WITH {TEXTS}, {TITLES}, {COMPANIES} SELECT id, CASE WHEN canonical = 'Google' THEN array_to_string(list_filter(list_transform(regexp_split_to_array(job_title_clean, '[,/|]|\\s[-–]\\s'), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(lower(x), 'google cloud')), ', ') ELSE job_title_clean END AS title FROM titles JOIN companies USING (id)")
def title_segments(spark, d):
    t = _texts(spark, d)
    return t.select("id", skills.strip_units(text.clean_title(F.col("job_title")), text.company(F.col("company_name"))["canonical"], UNITS).alias("title"))


#: Sentences that name two strings of the taxonomy: in a list, as a verb's object, before a noun, inside other words, around a point, after a phrase.
SENTENCES = ("Experience with {}, {}.", "We {} and {} daily", "{}/{} developer", "knowledge of x{} or {}y", "{}.{}", "go-to-market {} ({})")
STRINGS = [x for s in taxonomy() for x in (s.name, *s.aliases)]


def skilled_texts(spark, d):
    """id, text: a sentence for every order that names two strings of the taxonomy, by its own and its customer's key."""
    pick = lambda c, step: F.element_at(F.array(*map(F.lit, STRINGS)), (F.col(c) * step % len(STRINGS) + 1).cast("int"))
    forms = [F.format_string(s.replace("{}", "%s"), pick("o_orderkey", 7), pick("o_custkey", 11)) for s in SENTENCES]
    return roles.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*forms), (F.col("o_orderkey") % len(SENTENCES) + 1).cast("int")).alias("text"))


def _mention_sql(s: Skill) -> str:
    """Whether a lower-cased text names a skill, without look-around: the character beside a sign is part of the match."""
    if s.name == "Go":
        return r"len(regexp_extract_all(low, '\bgo\b')) > len(regexp_extract_all(low, '\bgo\b\s*[-\s]?to[-\s]market'))"
    quoted = lambda t: re.sub(r"([.+*?()|\[\]{}^$\\])", r"\\\1", t.lower()).replace("'", "''")
    side = lambda c, first: r"\b" if c.isalnum() else ("(?:^|[^0-9a-z_.])" if first else "(?:$|[^0-9a-z_.])")
    return "regexp_matches(low, '" + "|".join(side(t[0], True) + quoted(t) + side(t[-1], False) for t in (s.name, *s.aliases)) + "')"


def _sentence_sql(form: str) -> str:
    pick = lambda key, step: f"strings[CAST({key} * {step} % {len(STRINGS)} + 1 AS INT)]"
    a, b, c = form.split("{}")
    return f"'{a}' || {pick('o_orderkey', 7)} || '{b}' || {pick('o_custkey', 11)} || '{c}'"


_SKILLED = "sk AS (SELECT o_orderkey AS id, lower(CASE o_orderkey % {n} {whens} END) AS low FROM orders, (SELECT [{strings}] AS strings))".format(
    n=len(SENTENCES), whens=" ".join(f"WHEN {k} THEN {_sentence_sql(s)}" for k, s in enumerate(SENTENCES)), strings=", ".join(f"'{s}'" for s in STRINGS)
)


@query("skills_mentions", "WITH " + _SKILLED + " " + " UNION ALL ".join(f"SELECT '{s.name}' AS skill, count(*) AS postings FROM sk WHERE {_mention_sql(s)} HAVING count(*) > 0" for s in taxonomy()))
def mentioned(spark, d):
    """Orders' sentences by the skill of the whole taxonomy that they name, before any guard."""
    whole = taxonomy()
    found = skilled_texts(spark, d).select("id", F.explode(F.array_distinct(F.transform(skills.mentions(F.col("text"), whole), lambda m: m["skill"]))).alias("k"))
    return found.groupBy("k").agg(F.count("*").alias("postings")).select(F.element_at(F.array(*(F.lit(s.name) for s in whole)), F.col("k") + 1).alias("skill"), "postings")


@query("skills_accepted")
def accepted(spark, d):
    """Skills that the guards accept and refuse in the orders' sentences, in order of place; tests hold them against a plain rendering."""
    out = skills.from_text(skilled_texts(spark, d), F.col("text"), taxonomy(), "s")
    return out.select("id", F.array_join("s.accepted", "|").alias("accepted"), F.array_join(F.transform("s.rejected", lambda r: r["skill"]), "|").alias("rejected"))


@query(
    "company_set_manifest",
    f"""WITH {TEXTS}, {AUDIT}, own AS (SELECT a.key, a.b, r.posting_date FROM raw r JOIN audit a ON a.name = r.company_name WHERE reason = ''), bn AS (SELECT key, b, count(*) AS n FROM own GROUP BY ALL)
SELECT key AS company_key, count(*) AS postings, min(posting_date) AS first_posting, max(posting_date) AS last_posting, (SELECT string_agg(b || ' (' || n || ')', ', ' ORDER BY n DESC, b) FROM bn WHERE bn.key = own.key) AS brands FROM own GROUP BY 1""",
)
def company_manifest(spark, d):
    """The manifest of the companies of all orders' texts, as a run writes it."""
    root = f"{checkpoint_folder(spark)}/set-{uuid.uuid4().hex}"
    texts = _texts(spark, d).withColumns({"job_id": F.col("id").cast("string"), "source": F.lit("orders")})
    company_set.build(texts, rules(spark), root, TAXONOMY, UNITS)
    made = settled(company_set.read_manifest(spark, root))
    remove(spark, root)
    return made.select("company_key", "postings", F.col("first_posting").cast("string").alias("first_posting"), F.col("last_posting").cast("string").alias("last_posting"), "brands")
