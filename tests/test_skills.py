"""Skill mentions, guards, provenance and rule ladders on cases with known answers."""

import pytest
from pyspark.sql import functions as F

from postmeter.operators import skills, text
from postmeter.operators.skills import Skill

TAXONOMY = [
    Skill("Python", "Programming Language", ("python3",)),
    Skill("SQL", "Programming Language"),
    Skill("SQL Server", "Database"),
    Skill("C++", "Programming Language"),
    Skill("C", "Programming Language", guarded=True, qualifiers=(r"\bansi c\b",)),
    Skill("Go", "Programming Language", ("golang",), (r"\bgo\b(?!\s*[-\s]?to[-\s]market)",), True, (r"\bgolang\b",)),
    Skill("Machine Learning", "ML / AI", ("ml",), concept=True),
]


def found(spark, t):
    df = spark.createDataFrame([(t,)], "t string")
    return skills.from_text(df, F.col("t"), TAXONOMY, "s").select("s.*").first()


@pytest.mark.parametrize(
    "t,accepted,rejected",
    [
        ("We go to market fast", [], []),
        ("Let us go home", [], ["Go"]),
        ("Python, Go, SQL Server", ["Python", "Go", "SQL Server"], []),
        ("Experience with Go required", ["Go"], []),
        ("go where golang goes", ["Go"], []),
        ("C++ and machine learning", ["C++", "Machine Learning"], []),
        ("plan C is best", [], ["C"]),
        ("a Go developer", ["Go"], []),
        ("", [], []),
        (None, [], []),
        ("SQL then python3 then SQL", ["SQL", "Python"], []),
    ],
)
def test_mentions(spark, t, accepted, rejected):
    got = found(spark, t)
    assert got.accepted == accepted and [r.skill for r in got.rejected] == rejected


def test_snippets_show_what_was_refused(spark):
    assert found(spark, "the quick\n brown fox will go  home now").rejected[0].snippet.split() == "he quick brown fox will go home now".split()


def test_merged_and_features(spark):
    df = spark.createDataFrame([(["python", "sql", "nothing", "flow", "python"], "Go developer, ML", "x")], "skills_parsed array<string>, job_title_clean string, cleaned_description string").withColumn("company_canonical", F.lit("Acme"))
    r = skills.posting_features(df, TAXONOMY, {"Acme": ("ml",)}).first()
    assert r.skills_source == ["Python", "SQL"] and r.skills_title == ["Go"] and r.skills_final == ["Go", "Python", "SQL"]
    assert r.skill_provenance == "source+title" and r.skill_provenance_map == {"Go": "title", "Python": "source", "SQL": "source"}
    assert r.n_skills_programming_language == 3 and r.primary_skill_category == "Programming Language" and not r.has_ml_skill and not r.skill_recovered_by_title
    assert [tuple(x) for x in skills.unmapped(df, TAXONOMY).collect()] == [("nothing", 1)]


def test_claimed_twice():
    with pytest.raises(ValueError):
        skills.names_of([Skill("A", "Database", ("x",)), Skill("B", "Database", ("x",))])


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Mountain View, CA, USA", ("Mountain View", "CA", "United States")),
        ("London, England, UK", ("London", "England", "United Kingdom")),
        ("Dubai - United Arab Emirates", ("Dubai", "", "United Arab Emirates")),
        ("Riyadh Saudi Arabia", ("Riyadh", "", "Saudi Arabia")),
        ("Zürich, Switzerland", ("Zurich", "", "Switzerland")),
        ("Anywhere", ("", "", "")),
        (None, ("", "", "")),
    ],
)
def test_places(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "l string")
    assert tuple(df.select(text.location(F.col("l")).alias("p")).select("p.city", "p.region", "p.country").first()) == want


def test_lists_and_titles(spark):
    df = spark.createDataFrame([("['r', 'python', \"sas\", 'sas']", "{'a': ['Y', 'x', 'x'], 'b': 3}", "Données Analyst, Summer 2023"), ("a; B|a", "oops", "2023 summer intern data")], "l string, c string, t string")
    got = df.select(text.parse_list(F.col("l")), text.parse_categories(F.col("c")), text.clean_title(F.col("t")), text.title_suspect(F.col("t"))).collect()
    assert got[0][0] == ["r", "python", "sas"] and got[0][2] == "Donnees Analyst" and not got[0][3]
    assert got[1][0] == ["a", "b"] and got[1][1] == {} and got[1][3]


def regex_loop(taxonomy, text):
    """Places by one regex a skill, tried over the whole text."""
    import re

    compiled = [re.compile(s.pattern(), re.IGNORECASE) for s in taxonomy]
    return [{"start": m.start(), "end": m.end(), "skill": k} for k, c in enumerate(compiled) for m in c.finditer(text)]


def test_automaton_equals_the_regex_loop(spark, small):
    import random

    from postmeter.functions.taxonomy import taxonomy

    whole = taxonomy()
    assert len(whole) > 150 and len({s.name for s in whole}) == len(whole) and skills.names_of(whole)
    finder = skills.Finder(whole)
    rng = random.Random(6)
    tokens = [x.lower() for s in whole for x in (s.name, *s.aliases)]
    signs = [" ", "", ".", ", ", "/", "-", "_", " and ", "x", "9", "\n", "é", "ſ", "to-market", " to market", "+", "#"]
    texts = ["".join(rng.choice(tokens) + rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += [" ".join(rng.sample(tokens, 60)), "c++.net", ".net,asp.net node.js c#", "go go-to-market golang go to market", "ml mls tsql"]
    texts += [r.text.lower() for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text] + [r.html.lower() for r in spark.read.parquet(f"{small}/pages.parquet").collect() if r.html]
    for t in texts:
        assert finder.find(t) == regex_loop(whole, t), t
    assert finder.find("") == [] and finder.find(None) == []


def test_anchors_stand_in_every_match():
    for pattern, want in ((r"\bgo\b(?!\s*[-\s]?to[-\s]market)", "go"), (r"\b(?:microsoft|ms)\s+word\b", ""), (r"\bhive\s*ql\b", "hive"), (r"x?y{2}abc*d", "ab"), (r"[a-z]+\d", "")):
        assert skills.anchor(pattern) == want


def plain_guards(taxonomy, text):
    """Accepted and rejected skills by the rules told in audited(), one mention after another."""
    import re

    from postmeter.functions import vocabulary as V

    low = text.lower()
    found = [(m["start"], m["end"], taxonomy[m["skill"]], m["skill"]) for m in regex_loop(taxonomy, low)]
    sure = [m for m in found if not m[2].guarded]
    delimiters = re.escape(V.LIST_DELIMITERS)

    def good(start, end, s, _):
        if not s.guarded:
            return True
        before, after = low[max(0, start - 40) : start], low[end : end + 30]
        if any(re.search(q, low[max(0, start - 60) : end + 60], re.I) for q in s.qualifiers):
            return True
        if re.search(V.QUALIFIER_BEFORE, before, re.I) or re.search(V.QUALIFIER_AFTER, after, re.I):
            return True
        right = low[end : end + 12].lstrip(" ")
        listed = re.search(f"[{delimiters}]$", before.rstrip(" ")) or re.match(f"[{delimiters}]", right) or re.search(V.LIST_WORDS, before, re.I) or re.match("(?:and|or) ", right)
        return bool(listed) and any(a < end + 60 and b > max(0, start - 60) for a, b, *_ in sure)

    ok = [m for m in found if good(*m)]
    kept = [m for m in ok if not any(o[0] <= m[0] and m[1] <= o[1] and o[1] - o[0] != m[1] - m[0] for o in ok)]
    kept.sort(key=lambda m: (m[0], m[0] - m[1], m[3]))
    return list(dict.fromkeys(m[2].name for m in kept)), [m[2].name for m in found if not good(*m)]


def test_guards_against_a_plain_rendering(spark, small):
    from postmeter.functions.taxonomy import taxonomy
    from postmeter.plans import postings

    texts = {r.id: r.text for r in postings.skilled_texts(spark, small).collect()}
    got = {r.id: (r.accepted, r.rejected) for r in postings.accepted(spark, small).collect()}
    assert len(texts) == len(got) == 1500
    for i, t in texts.items():
        accepted, rejected = plain_guards(taxonomy(), t)
        assert got[i] == ("|".join(accepted), "|".join(rejected)), t


@pytest.mark.parametrize("table", [lambda f: skills.long_table(f, TAXONOMY), skills.rejected_mentions])
def test_skills_are_found_once(spark, table):
    """What a row's skills are made of stands in the plan as often as in the plan of the features alone, and postings without any have no row."""
    df = spark.createDataFrame([(1, "Go developer, ML", "let us go"), (2, "", "")], "id int, job_title_clean string, cleaned_description string").withColumn("company_canonical", F.lit("Acme"))
    featured = skills.posting_features(df, TAXONOMY)
    made = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("find(")
    assert made(table(featured)) <= made(featured)
    assert {r.id for r in table(featured).collect()} == {1}
