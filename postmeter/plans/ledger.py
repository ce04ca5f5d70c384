"""The claim ledger: candidates minted from rows of verdict tables, compiled through the gates, and the audits of what survives."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmeter import roles
from postmeter.operators import claims, compare, forecast, items, similarity, values, volume
from postmeter.plans.comparison import _LESS, RELATIVE, RELATIVE_BY, vendors
from postmeter.plans.items import bound
from postmeter.plans.registry import POSTINGS, query
from postmeter.plans.trends import VERDICT
from postmeter.sources.tables import settled

col, lit = F.col, F.lit


def volume_and_share(p):
    """The two tables that most claims rest on, a row an entity. Their branches read the postings p many times, so these are settled."""
    share = settled(compare.relative_share_verdict(compare.relative_share_by_publisher(p), compare.relative_share(p)))
    trend = settled(volume.panel_verdict(volume.panel_sensitivity(p)))
    return share, trend


def once(f):
    """f's result for a session's (tables' path), kept as long as the application: its tables are settled, and the given ones don't change."""
    kept = {}

    def get(spark, d):
        key = (spark.sparkContext.applicationId, d)
        if key not in kept:
            kept.clear()
            kept[key] = f(spark, d)
        return kept[key]

    return get


def segments(spark, d):
    """Names of the markets' regions: a sentence that holds one compares publishers, who are regional."""
    return roles.read(spark, d, "region").select(col("r_name").alias("segment"))


@once
def compiled(spark, d):
    """(claims, cells, ledger) of volume and share."""
    share, trend = volume_and_share(settled(roles.order_postings(spark, d)))
    all_cells = settled(claims.union([claims.cells(share, "relative_share", "entity"), claims.cells(trend, "volume", "entity")]))
    tempting = lambda words, k: claims.generate(trend, "volume", "entity", "spread", "", "which way volume moves", "structural", F.concat("entity", lit(words)), lit(""), "product", "none").withColumn("claim_id", F.replace("claim_id", lit("structural"), lit(f"tempting-{k}")))
    made = settled(claims.union([candidates_share(share), candidates_volume(trend), tempting(" will grow next year", 0), tempting(" hires mainly in Asia", 1)]))
    return made, all_cells, settled(claims.compile_ledger(made, all_cells, vocabulary=segments(spark, d)))


def candidates_share(share):
    text = F.concat("entity", lit(" was "), "direction", lit(" on the common panel"))
    clause = F.concat("publishers_agreeing", lit(" of "), "publishers_tested", lit(" publishers agree"))
    return claims.generate(share, "relative_share", "entity", "pooled_log_share_change", "verdict", "who gains share", "relative_share", text, clause, "strategy", "compare entities")


def candidates_volume(trend):
    return claims.generate(trend, "volume", "entity", "raw_final", "treatments_agree", "which way volume moves", "volume_treatments", F.concat("entity", lit(" shows "), "direction"), lit("all treatments agree"), "product", "none")


SHARES = f"""{RELATIVE}, {RELATIVE_BY}, rv AS (SELECT b.entity, r.log_share_change AS pooled, count(*) AS n, count(*) FILTER (sign(b.log_share_change) = sign(r.log_share_change)) AS agree FROM relby b JOIN relative r USING (entity) GROUP BY ALL),
sc AS (SELECT 'relative_share:' || entity AS claim_id, entity || ' was ' || CASE WHEN pooled > 0 THEN 'gaining share' WHEN pooled < 0 THEN 'losing share' ELSE 'flat' END || ' on the common panel' AS text, agree || ' of ' || n || ' publishers agree' AS clause, CASE WHEN agree > n / 2.0 THEN 'published_qualified' ELSE 'refused' END AS status FROM rv)"""


@query("claims_share_ledger", f"WITH {POSTINGS}, {SHARES} SELECT claim_id, text, clause, status FROM sc")
def share_ledger(spark, d):
    return compiled(spark, d)[2].filter("family = 'relative_share'").select("claim_id", "text", "clause", "status")


@query("claims_share_sentences", f"WITH {POSTINGS}, {SHARES} SELECT claim_id, text || ' — ' || clause AS sentence FROM sc WHERE status <> 'refused'")
def sentences(spark, d):
    return claims.published(compiled(spark, d)[2]).filter("question = 'who gains share'").select("claim_id", "sentence")


# The ledger of volume and share as SQL states it: a row a claim with its gates.
LEDGER = f"""{SHARES}, {VERDICT}, lc AS (
 SELECT 'relative_share:' || entity AS claim_id, 'who gains share' AS question, 'relative_share' AS family, entity || ' was ' || CASE WHEN pooled > 0 THEN 'gaining share' WHEN pooled < 0 THEN 'losing share' ELSE 'flat' END || ' on the common panel' AS text,
  'strategy' AS audience, 'compare entities' AS action, pooled IS NOT NULL AS evidence, TRUE AS clean, '' AS rule, CASE WHEN agree > n / 2.0 THEN 'published_qualified' ELSE 'refused' END AS inherited, 'relative_share' AS tab, round(pooled, 6)::VARCHAR::DOUBLE AS quoted FROM rv
 UNION ALL SELECT 'volume_treatments:' || entity, 'which way volume moves', 'volume_treatments', entity || ' shows ' || direction, 'product', 'none', raw_final IS NOT NULL, TRUE, '', CASE WHEN treatments_agree THEN 'published_qualified' ELSE 'refused' END, 'volume', raw_final FROM verdict
 UNION ALL SELECT 'tempting-0:' || entity, 'which way volume moves', 'structural', entity || ' will grow next year', 'product', 'none', spread IS NOT NULL, FALSE, 'forecast', 'published', 'volume', spread FROM verdict
 UNION ALL SELECT 'tempting-1:' || entity, 'which way volume moves', 'structural', entity || ' hires mainly in Asia', 'product', 'none', spread IS NOT NULL, FALSE, 'country_split', 'published', 'volume', spread FROM verdict),
ledger AS (SELECT *, inherited <> 'refused' AS identified, CASE WHEN NOT evidence THEN 'evidence' WHEN NOT clean THEN 'lint' WHEN inherited = 'refused' THEN 'identification' ELSE '' END AS blocked_by, CASE WHEN evidence AND clean THEN inherited ELSE 'refused' END AS status FROM lc)"""
_L = f"WITH {POSTINGS}, {LEDGER}"
_COUNTS = """count(*) AS generated, count(*) FILTER (evidence) AS evidence_bound, count(*) FILTER (evidence AND clean) AS lint_clean, count(*) FILTER (evidence AND clean AND identified) AS identified, count(*) FILTER (status = 'published') AS published,
 count(*) FILTER (status = 'published_qualified') AS published_qualified, count(*) FILTER (status = 'refused') AS refused, round(100 * count(*) FILTER (status <> 'refused') / count(*)::DOUBLE, 6) AS yield_pct"""
AUDITS = {
    "funnel": (claims.funnel, f"{_L} SELECT coalesce(question, 'all') AS question, {_COUNTS} FROM ledger GROUP BY ROLLUP (question)"),
    "refusals": (claims.refusals, f"{_L} SELECT claim_id, question, family, text, blocked_by FROM ledger WHERE status = 'refused'"),
    "question_coverage": (claims.question_coverage, f"{_L} SELECT question, count(*) AS generated, count(*) FILTER (status <> 'refused') AS answerable, count(*) FILTER (status = 'published') AS firm, CASE WHEN count(*) FILTER (status <> 'refused') = 0 THEN 'no sentence available' WHEN count(*) FILTER (status = 'published') = 0 THEN 'answerable only on a qualified verdict' ELSE 'answerable' END AS answer FROM ledger GROUP BY 1"),
    "actionability": (claims.actionability, f"{_L} SELECT audience, count(*) AS claims_available, count(*) FILTER (NOT starts_with(lower(trim(action)), 'none')) AS actionable, array_to_string(list_sort(list(DISTINCT question)), ', ') AS questions_covered FROM ledger WHERE status <> 'refused' GROUP BY 1"),
    "provenance": (claims.provenance, f'{_L} SELECT tab AS "table", count(*) AS claims, count(DISTINCT family) AS families FROM ledger GROUP BY 1'),
}
for _name, (_f, _sql) in AUDITS.items():

    @query(f"claims_{_name}", _sql)
    def _table(spark, d, f=_f):
        return f(compiled(spark, d)[2])


@query("claims_bindings", f"{_L} SELECT claim_id, round(quoted, 6) AS quoted, round(quoted, 6) AS actual, evidence AS bound FROM ledger")
def bindings(spark, d):
    """What every claim quotes and what its cell holds, as numbers."""
    made, all_cells, _ = compiled(spark, d)
    return claims.bindings(made, all_cells).withColumns({"quoted": col("quoted").cast("double"), "actual": col("actual").cast("double")})


@query("claims_lint_counts", f"{_L}, names AS (SELECT unnest({[*claims.LINT, claims.SEGMENT_RULE]!r}) AS rule) SELECT rule, (SELECT count(*) FROM ledger l WHERE l.rule = names.rule) AS caught, 0::BIGINT AS exempted FROM names")
def lint_counts(spark, d):
    return claims.lint_counts(compiled(spark, d)[0], segments(spark, d))


@query("claims_directions", f"WITH {POSTINGS}, {SHARES} SELECT claim_id, CASE WHEN text LIKE '%gaining%' THEN 'up' WHEN text LIKE '%losing%' THEN 'down' ELSE '' END AS asserted, CASE WHEN text LIKE '%gaining%' THEN 'up' WHEN text LIKE '%losing%' THEN 'down' ELSE '' END AS recorded, TRUE AS agrees FROM sc")
def directions(spark, d):
    made, all_cells, _ = compiled(spark, d)
    return claims.directions(made.filter("family = 'relative_share'"), all_cells)


@query("claims_citations", f"WITH {POSTINGS}, {SHARES} SELECT claim_id, 'relative_share' AS cited_table, 'pooled_log_share_change' AS cited_column, replace(claim_id, 'relative_share:', '') AS cited_row FROM sc")
def citations(spark, d):
    made = compiled(spark, d)[0].filter("family = 'relative_share'")
    return made.select("claim_id", claims.parse_citation(col("citation")).alias("c")).select("claim_id", col("c.table").alias("cited_table"), col("c.column").alias("cited_column"), col("c.selector")["entity"].alias("cited_row"))


@query("claims_segment_vocabulary", f"WITH {POSTINGS} SELECT DISTINCT segment FROM postings WHERE segment IS NOT NULL")
def vocabulary(spark, d):
    return claims.segment_vocabulary(roles.order_postings(spark, d))


@query("claims_consistency", f"""WITH {POSTINGS}, {RELATIVE} SELECT 'share change of ' || entity AS quantity, entity AS row, share_change_pp::VARCHAR::DOUBLE AS earlier, round((h2_share - h1_share) * 100, 2) AS later, 0.0::DOUBLE AS delta, FALSE AS conflict FROM relative""")
def consistency(spark, d):
    """The change of share as the relative-share table states it, against the same change from its two shares."""
    share = settled(compare.relative_share(roles.order_postings(spark, d)))
    again = share.select("entity", F.round((col("h2_share") - col("h1_share")) * 100, 2).alias("change"))
    all_cells = claims.union([claims.cells(share, "relative_by_half", "entity"), claims.cells(again, "restated", "entity")])
    restated = share.select(F.concat(lit("share change of "), "entity").alias("quantity"), lit("relative_by_half").alias("earlier_table"), lit("share_change_pp").alias("earlier_column"), lit("restated").alias("later_table"), lit("change").alias("later_column"), col("entity").alias("row"))
    out = claims.consistency(all_cells, restated)
    return out.select("quantity", "row", col("earlier_value").cast("double").alias("earlier"), col("later_value").cast("double").alias("later"), F.coalesce("delta", lit(0.0)).alias("delta"), "conflict")


@query("claims_identifiers", "SELECT DISTINCT p_name AS name, trim(regexp_replace(replace(replace(lower(p_name) || ' c++', '++', '-plus-plus'), '/', '-'), '[^a-z0-9]+', '-', 'g'), '-') AS identifier FROM part")
def identifiers(spark, d):
    return roles.read(spark, d, "part").select(col("p_name").alias("name"), claims.identifier(F.concat("p_name", lit(" c++"))).alias("identifier")).distinct()


# Citations with one to three keys over two tables with a row for each publisher and entity: sound ones, one that matches several rows, and four that match none.


@query(
    "claims_multi_key_citations",
    f"""WITH {POSTINGS}, {RELATIVE}, {RELATIVE_BY}, pe AS (SELECT publisher, entity, segment, count(*) AS n FROM postings WHERE publisher IS NOT NULL AND segment IS NOT NULL GROUP BY ALL), hit AS (
 SELECT 'mix#n@entity=' || entity || ',publisher=' || publisher || ',segment=' || segment AS citation, n::VARCHAR AS value, 1 AS matches, '' AS problem FROM pe
 UNION ALL SELECT 'moves#h1_postings@publisher=' || lower(publisher) || ',entity= ' || entity || ' ', h1_postings::VARCHAR, 1, '' FROM relby
 UNION ALL SELECT DISTINCT 'mix#n@entity=' || entity, NULL, (SELECT count(*) FROM pe q WHERE q.entity = pe.entity), CASE WHEN (SELECT count(*) FROM pe q WHERE q.entity = pe.entity) > 1 THEN 'several rows' ELSE '' END FROM pe
 UNION ALL SELECT DISTINCT 'mix#n@entity=' || entity || ',publisher=NOWHERE', NULL, 0, 'no row' FROM pe
 UNION ALL SELECT DISTINCT 'mix#gone@entity=' || entity, NULL, (SELECT count(*) FROM pe q WHERE q.entity = pe.entity), 'no such column' FROM pe
 UNION ALL SELECT DISTINCT 'mix#n@colour=' || entity, NULL, 0, 'no such key' FROM pe UNION ALL SELECT DISTINCT 'none#n@entity=' || entity, NULL, 0, 'no such table' FROM pe)
SELECT citation, value, CAST(matches AS BIGINT) AS matches, problem FROM hit""",
)
def multi_key_citations(spark, d):
    p = roles.order_postings(spark, d)
    mixed = settled(p.filter("publisher is not null and segment is not null").groupBy("publisher", "entity", "segment").agg(F.count("*").alias("n")))
    moves = settled(compare.relative_share_by_publisher(p))
    all_cells = settled(claims.cells(mixed, "mix", "publisher", "entity", "segment").unionByName(claims.cells(moves, "moves", "publisher", "entity")))
    e = mixed.select("entity").distinct()
    made = [
        mixed.select(claims.cited(lit("mix"), lit("n"), entity=col("entity"), publisher=col("publisher"), segment=col("segment")).alias("citation")),
        moves.select(F.concat(lit("moves#h1_postings@publisher="), F.lower("publisher"), lit(",entity= "), "entity", lit(" ")).alias("citation")),
        *(e.select(F.concat(lit(before), "entity", lit(after)).alias("citation")) for before, after in (("mix#n@entity=", ""), ("mix#n@entity=", ",publisher=NOWHERE"), ("mix#gone@entity=", ""), ("mix#n@colour=", ""), ("none#n@entity=", ""))),
    ]
    return claims.resolve(claims.union(made), all_cells).select("citation", "value", "matches", "problem")


#: Terms of claims that rest on several verdicts; the weakest decides.
_SEVERAL = {
    "both": ("relative_share:share#verdict@entity={e} & feasible:screen#included@entity={e}", "CASE WHEN v = 'not supported' OR NOT inc THEN 'refused' ELSE 'published_qualified' END", "v || ' & ' || inc::VARCHAR"),
    "structural": ("relative_share:share#verdict@entity={e} & structural:", "CASE WHEN v = 'not supported' THEN 'refused' ELSE 'published_qualified' END", "v || ' & structural'"),
    "dangling": ("structural: & feasible:screen#included@entity={e},publisher=x", "'refused'", "'structural & structural'"),
    "nothing": ("", "'refused'", "NULL"),
}


@query(
    "claims_several_verdicts",
    f"""WITH {POSTINGS}, {RELATIVE}, {RELATIVE_BY}, rv AS (SELECT b.entity, r.log_share_change AS pooled, count(*) AS n, count(*) FILTER (sign(b.log_share_change) = sign(r.log_share_change)) AS agree FROM relby b JOIN relative r USING (entity) GROUP BY ALL),
x AS (SELECT entity, CASE WHEN agree = n THEN 'confirmed' WHEN agree > n / 2.0 THEN 'mixed' ELSE 'not supported' END AS v, (SELECT count(*) >= 250 AND count(DISTINCT date_trunc('month', day)) >= 10 FROM postings p WHERE p.entity = rv.entity) AS inc FROM rv)
{' UNION ALL '.join(f"SELECT '{k}:' || entity AS claim_id, {verdict} AS verdict, {status} AS inherited FROM x" for k, (_, status, verdict) in _SEVERAL.items())}""",
)
def several_verdicts(spark, d):
    """Claims on an entity that rest on two verdicts at once, on one and a structural fact, on a citation that doesn't resolve, and on nothing."""
    p = roles.order_postings(spark, d)
    share = settled(compare.relative_share_verdict(compare.relative_share_by_publisher(p), compare.relative_share(p)))
    screen = settled(compare.feasibility_screen(p).withColumn("included", col("verdict") == "included").drop("verdict"))
    all_cells = settled(claims.cells(share, "share", "entity").unionByName(claims.cells(screen, "screen", "entity")))
    made = claims.union([share.select(F.concat(lit(f"{k}:"), "entity").alias("claim_id"), F.replace(lit(form), lit("{e}"), col("entity")).alias("rests_on"), lit("share#verdict").alias("citation")) for k, (form, _, _) in _SEVERAL.items()])
    return claims.inherited(made, all_cells)


# The change of share between halves as first stated, without February, and over all months again: each replaces the one before.
REGISTER = "R1"


def restated(spark, d):
    """(cells, register, share verdicts) of changes of share that are stated more than once."""
    p = roles.order_postings(spark, d)
    first = settled(compare.relative_share(p))
    less = settled(compare.relative_share(p.filter(F.month("day") != 2)))
    verdicts = settled(compare.relative_share_verdict(compare.relative_share_by_publisher(p), first))
    all_cells = settled(claims.union([claims.cells(first, "by_half", "entity"), claims.cells(less, "without_february", "entity"), claims.cells(verdicts, "verdicts", "entity")]))
    entry = lambda v, table: first.select(F.concat(lit("share change of "), "entity").alias("quantity"), lit(v).alias("version"), claims.cited(lit(table), lit("share_change_pp"), entity=col("entity")).alias("citation"), lit(REGISTER).alias("register"))
    return all_cells, claims.union([entry(1, "by_half"), entry(2, "without_february")]), first, verdicts


_RESTATED = f"""{RELATIVE}, {RELATIVE_BY}, kept AS (SELECT * FROM postings WHERE month(day) <> 2), {_LESS}, rv AS (SELECT b.entity, r.log_share_change AS pooled, count(*) AS n, count(*) FILTER (sign(b.log_share_change) = sign(r.log_share_change)) AS agree FROM relby b JOIN relative r USING (entity) GROUP BY ALL),
two AS (SELECT r.entity, r.share_change_pp AS a, s.share_change_pp AS b, NOT coalesce(abs(r.share_change_pp - s.share_change_pp) <= greatest(0.0005, 0.02 * abs(s.share_change_pp)), TRUE) AS conflict FROM relative r JOIN relative2 s USING (entity))"""


@query(
    "claims_supersessions",
    f"""WITH {POSTINGS}, {_RESTATED} SELECT 'share change of ' || entity AS quantity, CAST(1 AS BIGINT) AS version, 'by_half#share_change_pp@entity=' || entity AS citation, a AS value, 'without_february#share_change_pp@entity=' || entity AS latest_citation, b AS latest_value, round(b - a, 4) AS delta, conflict, '{REGISTER}' AS register FROM two""",
)
def supersessions(spark, d):
    """Changes of share as first stated, beside the same change without February, computed from the postings again."""
    all_cells, register, _, _ = restated(spark, d)
    out = claims.supersessions(register, all_cells).drop("table", "row", "line", "column")
    return out.withColumns({"value": col("value").cast("double"), "latest_value": col("latest_value").cast("double")})


@query(
    "claims_consistency_gate",
    f"""WITH {POSTINGS}, {_RESTATED}, g AS (SELECT two.*, agree > n / 2.0 AS ident FROM two JOIN rv USING (entity)), c AS (SELECT 'old:' || entity AS claim_id, ident, conflict AS bad FROM g UNION ALL SELECT 'named:' || entity, ident, FALSE FROM g UNION ALL SELECT 'new:' || entity, ident, FALSE FROM g)
SELECT claim_id, NOT bad AS gate_consistency, CASE WHEN NOT ident THEN 'identification' WHEN bad THEN 'consistency' ELSE '' END AS blocked_by, CASE WHEN ident AND NOT bad THEN 'published_qualified' ELSE 'refused' END AS status FROM c""",
)
def consistency_gate(spark, d):
    """Sentences that cite a replaced value, the same ones naming the register's entry, and sentences that cite the value that holds."""
    all_cells, register, first, verdicts = restated(spark, d)
    less = settled(compare.relative_share(roles.order_postings(spark, d).filter(F.month("day") != 2)))

    def stated(table, name, prefix, clause):
        both = table.join(verdicts.select("entity"), "entity", "left_semi")
        text = F.concat("entity", lit(" changed its share by "), claims.stated(col("share_change_pp")), lit(" points"))
        made = claims.generate(both, name, "entity", "share_change_pp", "", "who gains share", "relative_share", text, lit(clause), "strategy", "compare entities")
        entity = F.split_part("claim_id", lit(":"), lit(2))
        return made.withColumns({"claim_id": F.concat(lit(f"{prefix}:"), entity), "rests_on": F.concat(lit("relative_share:"), claims.cited(lit("verdicts"), lit("verdict"), entity=entity))})

    made = claims.union([stated(first, "by_half", "old", "on the common panel"), stated(first, "by_half", "named", f"on the common panel; see {REGISTER}"), stated(less, "without_february", "new", "on the common panel")])
    return claims.compile_ledger(made, all_cells, claims.supersessions(register, all_cells)).select("claim_id", "gate_consistency", "blocked_by", "status")


def tables(spark, d) -> dict:
    """Every table that candidates rest on, settled: name -> (table, its keys). Postings and items are joined once, into counts that all shares of items are sums of."""
    p, i, _ = bound(spark, d)
    share, trend = volume_and_share(p)
    per = settled(items.counted(p, i))
    item_share = settled(compare.item_share(p, per))
    series = settled(forecast.panel_share_series(p))
    gate = settled(forecast.forecastability(series))
    tested = settled(forecast.backtest(series))
    profile = settled(similarity.profiles(p, per))
    within = items.stratified_verdict(items.trend_within_segment(p, per))
    pair = similarity.pair_verdicts(similarity.bootstrap(p, i), similarity.pair_table(profile), similarity.vendor_sensitivity(profile, vendors(spark, d)), similarity.mix_sensitivity(compare.standardised_items(p, per, compare.supported_items(item_share))))
    passing = gate.filter("verdict = 'forecastable'").select("key")
    found = {
        "relative_share": (share, "entity"),
        "volume": (trend, "entity"),
        "segments": (volume.compare_panels(p), "entity", "segment"),
        "skill_trend": (items.pooled_against_strata(items.trend(p, per), within), "entity", "item"),
        "skill_gap": (compare.stratified_entity_verdict(compare.within_stratum(p, per, compare.top_items(item_share))), "item", "entity_a", "entity_b"),
        "distinctiveness": (compare.distinctiveness(item_share, vendors(spark, d)), "entity", "item"),
        "forecastability": (gate, "key"),
        "horizons": (forecast.horizons(tested.join(passing, "key", "left_semi")), "horizon"),
        "forecast": (forecast.forecast(series, forecast.select_model(tested), tested, gate), "key", "horizon"),
        "similarity": (pair.join(similarity.pair_table(profile).select("entity_a", "entity_b", "cosine"), ["entity_a", "entity_b"]), "entity_a", "entity_b"),
        "trajectory": (similarity.trajectories(series, gate), "entity_a", "entity_b"),
        "values": (values.disclosure(p), "entity"),
        "value_pairs": (values.stratified_pairs(p, n_boot=200).select("publisher", "segment", "entity_a", "entity_b", "difference", "identified"), "publisher", "segment", "entity_a", "entity_b"),
        "collection": (compare.comparability(p), "entity"),
    }
    return {name: (settled(t), tuple(keys)) for name, (t, *keys) in found.items()}


def candidates(t: dict):
    """Claims of all generators. Every sentence states the quantity of the cell that it cites, and rests on the verdicts of the same row."""
    tempting = {
        "forecast": " will grow next year", "convergence": " is converging with its rivals", "level": " posted more roles than its rivals", "product": " plans to launch a product", "headcount": " raised headcount",
        "all": " asks for it in 30% of all postings", "season": " has a seasonal peak", "cause": " shifted in response to a rival", "region": " hires mainly in Europe",
    }

    def make(name, column, verdict, question, family, text, clause, audience, action):
        table, keys = t[name]
        return claims.generate(table, name, keys, column, verdict, question, family, text, clause, audience, action).withColumn("claim_id", F.concat_ws(":", lit(name), lit(column), "claim_id"))

    n, pct = claims.stated, claims.percent
    lead = lambda then, other: F.when(col("pooled_diff") > 0, col(then)).otherwise(col(other))
    inside = F.when(col("verdict").startswith("rising"), " is rising").when(col("verdict").startswith("falling"), " is falling").otherwise(" moves")
    against = F.when(col("status") == "reversed", lit("inside every segment, against its pooled share, which changed by ")).otherwise(lit("inside segments; its pooled share changed by "))
    own = [
        make("relative_share", "pooled_log_share_change", "verdict", "hiring_patterns", "relative_share", F.concat("entity", lit(" was "), "direction", lit(" on the common panel, a log change of "), n(col("pooled_log_share_change"), 3)), F.concat("publishers_agreeing", lit(" of "), "publishers_tested", lit(" publishers agree")), "strategy", "compare entities"),
        make("volume", "raw_final", "treatments_agree", "hiring_patterns", "volume_treatments", F.concat("entity", lit(" shows "), "direction", lit(", an index of "), n(col("raw_final"))), lit("all treatments of the panel agree"), "product", "none"),
        make("segments", "share_delta", "directions_agree", "hiring_patterns", "segment_panel", F.concat(lit("the share of "), "segment", lit(" in "), "entity", lit(" changed by "), n(col("share_delta"), 4), lit(" between halves")), lit("a share also moves when another segment does"), "product", "plan by segment"),
        make("skill_trend", "pooled_delta", "verdict", "skill_demand", "skill_stratified", F.concat("item", lit(" at "), "entity", inside, lit(" "), against, n(col("pooled_delta"), 4)), lit(""), "engineering", "train"),
        make("skill_gap", "pooled_diff", "verdict", "skill_demand", "skill_gap", F.concat(lead("entity_a", "entity_b"), lit(" asks for "), "item", lit(" oftener than "), lead("entity_b", "entity_a"), lit(", by "), n(F.abs("pooled_diff"), 4), lit(", in "), "n_agree", lit(" of "), "n_strata", lit(" segments")), lit(""), "engineering", "train"),
        make("distinctiveness", "diff", "significant", "position", "distinctiveness", F.concat("entity", lit(" names "), "item", lit(" in "), pct(col("share")), lit(" of its postings with items, others in "), pct(col("rest_share"))), F.when(col("self_referential"), "its own product").otherwise(""), "strategy", "position"),
        make("forecastability", "signal_share", "verdict", "future_demand", "forecastable", F.concat("key", lit("'s series is "), pct(col("signal_share")), lit(" signal")), lit("passing the gate does not make a forecast useful"), "product", "none"),
        make("horizons", "interval_factor", (("horizon", "sufficient"),), "future_demand", "horizon", F.concat(lit("at "), "horizon", lit(" months the middle interval is "), n(col("interval_factor")), lit(" times as wide as its lower end")), lit("wide intervals exclude nothing"), "product", "none"),
        make("forecast", "point_share", (("feasible", "supported"),), "future_demand", "horizon", F.concat("key", lit(" stands at a share of "), n(col("point_share"), 4), lit(" at step "), "horizon"), lit("by the model that was selected"), "product", "none"),
        make("similarity", "cosine", "verdict", "position", "similarity_pair", F.concat("entity_a", lit(" and "), "entity_b", lit(" are the "), claims.ordinal(col("rank")), lit(" closest pair, at a cosine of "), n(col("cosine"), 4)), lit("of what they ask for, not of what they do"), "strategy", "position"),
        make("trajectory", "r_log_share", (("feasible", "eligible"), ("feasible", "excludes_zero")), "trajectory", "feasible", F.concat("entity_a", lit(" and "), "entity_b", lit(" moved together, a correlation of "), n(col("r_log_share"), 4)), lit("over the common periods of a closed composition"), "strategy", "none"),
        make("values", "disclosed_share", "", "position", "structural", F.concat("entity", lit(" states a value in "), pct(col("disclosed_share")), lit(" of its postings")), lit("disclosure is the publisher's choice"), "product", "none"),
        make("value_pairs", "difference", (("feasible", "identified"),), "position", "feasible", F.concat(lit("in "), "segment", lit(" on "), "publisher", lit(", the median value of "), "entity_a", lit(" differs from that of "), "entity_b", lit(" by "), n(col("difference"))), lit("disclosed values of one publisher and segment only"), "product", "none"),
        make("collection", "common_panel_share", "", "collection", "structural", F.concat(pct(col("common_panel_share")), lit(" of "), "entity", lit(" stands on the common panel")), lit(""), "product", "none"),
        make("collection", "publishers", "", "collection", "structural", F.concat("entity", lit(" reaches readers over "), "publishers", lit(" publishers")), lit(""), "product", "none"),
    ]
    own += [make("collection", "postings", "", "collection", "structural", F.concat("entity", lit(text)), lit(""), "product", "none").withColumn("claim_id", F.concat(lit(f"tempting-{k}:"), "claim_id")) for k, text in tempting.items()]
    return claims.union(own)


@once
def full(spark, d):
    """(tables, claims, ledger) of all generators."""
    t = tables(spark, d)
    all_cells = settled(claims.union([claims.cells(x, name, *keys) for name, (x, keys) in t.items()]))
    made = settled(candidates(t))
    return {name: x for name, (x, _) in t.items()}, made, settled(claims.compile_ledger(made, all_cells, vocabulary=segments(spark, d)))


@query("claims_candidates")
def all_candidates(spark, d):
    """claim_id, family, text, value of every candidate."""
    return full(spark, d)[1].select("claim_id", "question", "family", "text", "value")


@query("claims_full_ledger")
def full_ledger(spark, d):
    return full(spark, d)[2].select("claim_id", "family", "gate_evidence", "gate_lint", "gate_identification", "gate_consistency", "blocked_by", "status")


@query("claims_promises")
def promises(spark, d):
    return claims.promise_audit(full(spark, d)[2])


@query("claims_position")
def position(spark, d):
    t, _, ledger = full(spark, d)
    return claims.strategy_position(ledger, t["similarity"].select("entity_a", "entity_b", col("cosine").alias("value"), "verdict"), "AUTOMOBILE")


@query("claims_brief")
def brief(spark, d):
    return claims.audience_brief(full(spark, d)[2], "strategy")


FALSIFIERS = {"relative_share": "a shared publisher that points the other way", "distinctiveness": "a share inside the others' interval", "similarity_pair": "a redrawing in which the rank moves", "structural": "another count of the panel", "skill_stratified": "a segment that moves the other way"}


@query("claims_falsifiers")
def falsifiers(spark, d):
    return claims.falsifiers(full(spark, d)[2], FALSIFIERS)
