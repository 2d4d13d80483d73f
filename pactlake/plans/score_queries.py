"""Registered queries over the fact view: rules, scores, statutes, remedies, legal aid."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlake.functions.predicates import compile_predicate, predicate_sql
from pactlake.operators import legal_aid, remedies, rubric, statutes
from pactlake.plans import derive
from pactlake.plans.rules import BANDS, CONSTRUCTS, EXPLANATIONS, LIMITATIONS, NUMBERS, PREREQUISITES, RULES, SATURATION, STAGES, STATUTES, TIER_CAPS, VERDICT_WEIGHTS, FORUMS, inputs, question

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def view(spark, sf_dir):
    return derive.frame(spark, sf_dir, derive.FACTS)


def situations(spark, sf_dir):
    return derive.frame(spark, sf_dir, derive.SITUATIONS)


V = f"v AS ({derive.text(derive.FACTS)})"
S = f"s AS ({derive.text(derive.SITUATIONS)})"


def _applies_sql(types) -> str:
    return "TRUE" if not types else f"document_type IN ({', '.join(repr(t) for t in types)})"


_ALL = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule_order, '{r[0]}' AS rule_id, '{r[1]}' AS tier, '{r[2]}' AS severity, {r[3]} AS points, '{r[5]}' AS evidence_from, "
    f"{predicate_sql(r[6])} AS outcome FROM v WHERE {_applies_sql(r[4])}"
    for i, r in enumerate(RULES)
)
E = f"{V}, e AS ({_ALL})"
_TOTALS = ", ".join(f"least(coalesce(sum(points) FILTER (WHERE tier = '{t}' AND outcome), 0), {cap}) AS {t}" for t, cap in TIER_CAPS.items())
T = f"{E}, g AS (SELECT doc_id, {_TOTALS} FROM e GROUP BY doc_id)"
_RAW = " + ".join(TIER_CAPS)
_SCORE = f"CAST(floor(100 * (1 - exp(-({_RAW}) / {float(SATURATION)})) + 0.5) AS INTEGER)"
_BAND = "CASE " + " ".join(f"WHEN score <= {top} THEN '{b}'" for top, b in BANDS) + f" ELSE '{BANDS[-1][1]}' END"

_PREDICATES = {
    "R1_pred_compare": [("gte", "lockInMonths", 4), ("gt", "lockInMonths", 6), ("lte", "termMonths", 12), ("lt", "paymentTermDays", 45)],
    "R2_pred_ratio_gte": [("ratio_gte", "noticeDaysYouMustGive", "noticeDaysTheyMustGive", 2), ("ratio_gte", "cureDaysTheyGet", "cureDaysYouGet", 1.5)],
    "R3_pred_multiple_gte": [("multiple_gte", "securityDepositInr", "monthlyRentInr", 1, 3), ("multiple_gte", "bondAmountInr", "annualCtcInr", 12, 6)],
    "R4_pred_construct": [("construct_present", "self_help_remedy"), ("construct_absent", "jurisdiction_clause")],
    "R5_pred_field_missing": [("field_missing", "liabilityCapInr")],
    "R6_pred_logic": [
        ("all_of", ("gt", "lockInMonths", 6), ("construct_present", "cross_default")), ("any_of", ("gt", "lockInMonths", 6), ("construct_present", "cross_default")),
        ("not", ("any_of", ("field_missing", "termMonths"), ("gte", "termMonths", 24))),
    ],
}
for _name, _ps in _PREDICATES.items():
    query(_name, f"WITH {V} SELECT doc_id, " + ", ".join(f"{predicate_sql(p)} AS p{i}" for i, p in enumerate(_ps)) + " FROM v")(
        lambda spark, d, ps=_ps: view(spark, d).select("doc_id", *[compile_predicate(p).alias(f"p{i}") for i, p in enumerate(ps)])
    )


@query(
    "R7_predicate_inputs",
    f"WITH {V}, i AS (" + " UNION ALL ".join(f"SELECT '{r[0]}' AS rule_id, {n} AS pos, '{x}' AS name" for r in RULES for n, x in enumerate(inputs(r[6]), 1)) + "), c AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS name, count({x}) AS known FROM v" for x in [*NUMBERS, *CONSTRUCTS]) + ") SELECT rule_id, pos, i.name, known FROM i JOIN c USING (name)",
)
def predicate_inputs(spark, d):
    names = [*NUMBERS, *CONSTRUCTS]
    table = spark.createDataFrame([(r[0], n, x) for r in RULES for n, x in enumerate(inputs(r[6]), 1)], "rule_id string, pos int, name string")
    counts = view(spark, d).agg(*[F.count(x).alias(x) for x in names]).unpivot([], names, "name", "known")
    return F.broadcast(table).join(counts, "name").select("rule_id", "pos", "name", "known")


@query("R8_evaluate_rules", f"WITH {E} SELECT doc_id, rule_order, rule_id, tier, severity, points, evidence_from, outcome FROM e")
def evaluate_rules(spark, d):
    return rubric.evaluate_rules(view(spark, d))


def _grouped_sql(field: str) -> str:
    whole = f"CAST(CAST({field} AS BIGINT) AS VARCHAR)"
    head = f"reverse(rtrim(regexp_replace(reverse(substring({whole}, 1, length({whole}) - 3)), '(\\d\\d)', '\\1,', 'g'), ','))"
    return f"CASE WHEN length({whole}) <= 3 THEN {whole} ELSE concat({head}, ',', right({whole}, 3)) END"


def _text_sql(template: str) -> str:
    parts = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        parts.append(f"({_grouped_sql(part)})" if i % 2 else f"'{part}'")
    return " || ".join(parts)


@query("R10_render_explanations", f"WITH {V} " + " UNION ALL ".join(f"SELECT doc_id, '{r[0]}' AS rule_id, {_text_sql(EXPLANATIONS[r[0]])} AS text FROM v WHERE {_applies_sql(r[4])} AND {predicate_sql(r[6])}" for r in RULES))
def render_explanations(spark, d):
    return rubric.explanations(view(spark, d))


def _missing_sql(r) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in inputs(r[6])) + ")"


@query(
    "R11_unknown_questions",
    f"WITH {V}, u AS (" + " UNION ALL ".join(
        f"SELECT doc_id, {i} AS o, '{r[0]}' AS rule_id, '{question(r[0])}' AS question, {_missing_sql(r)} AS missing FROM v "
        f"WHERE {_applies_sql(r[4])} AND {predicate_sql(r[6])} IS NULL" for i, r in enumerate(RULES))
    + ") SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INTEGER) AS number, rule_id, question, missing FROM u",
)
def unknown_questions(spark, d):
    return rubric.unknown_questions(view(spark, d)).withColumn("missing", F.array_join("missing", ","))


@query("R12_tier_totals", f"WITH {T} SELECT doc_id, {', '.join(f'CAST({t} AS INTEGER) AS {t}' for t in TIER_CAPS)} FROM g")
def tier_totals(spark, d):
    return rubric.tier_totals(view(spark, d))


@query("R13_risk_score", f"WITH {T} SELECT doc_id, {_SCORE} AS score FROM g")
def risk_score(spark, d):
    return rubric.score_documents(view(spark, d)).select("doc_id", "score")


@query("R14_risk_band", f"WITH {T}, r AS (SELECT doc_id, {_SCORE} AS score FROM g) SELECT doc_id, {_BAND} AS band FROM r")
def risk_band(spark, d):
    return rubric.score_documents(view(spark, d)).select("doc_id", "band")


_TOP = f"{E}, k AS (SELECT doc_id, rule_id, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, rule_id) AS place FROM e WHERE outcome)"


@query("R15_top_drivers", f"WITH {_TOP} SELECT doc_id, CAST(place AS INTEGER) AS place, rule_id FROM k WHERE place <= 3")
def top_drivers(spark, d):
    return view(spark, d).select("doc_id", F.posexplode(rubric.top_drivers()).alias("place", "rule_id")).withColumn("place", F.col("place") + 1)


@query(
    "R16_score_documents",
    f"WITH {T}, k AS (SELECT doc_id, rule_id, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, rule_id) AS place FROM e WHERE outcome), "
    "h AS (SELECT doc_id, string_agg(rule_id, ',' ORDER BY place) AS top_drivers FROM k WHERE place <= 3 GROUP BY doc_id), "
    f"r AS (SELECT v.doc_id, document_type, {', '.join(f'CAST(coalesce({t}, 0) AS INTEGER) AS {t}' for t in TIER_CAPS)}, coalesce(top_drivers, '') AS top_drivers "
    f"FROM v LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id)), z AS (SELECT *, {_SCORE} AS score FROM r) SELECT *, {_BAND} AS band FROM z",
)
def score_documents(spark, d):
    return rubric.score_documents(view(spark, d))


# --- statutes -----------------------------------------------------------------------------------
_STATUTE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS construct, '{v}' AS verdict, '{conf}' AS confidence, '{sec}' AS section, {i} AS statute_order, {VERDICT_WEIGHTS[v]} AS w "
    f"FROM v WHERE {c} AND {_applies_sql(types)}" for i, (c, v, conf, sec, types) in enumerate(STATUTES)
)
TRIAGE = f"{V}, t AS ({_STATUTE_ROWS})"


@query("E1_triage", f"WITH {TRIAGE} SELECT doc_id, construct, verdict, confidence, section, statute_order FROM t")
def triage(spark, d):
    return statutes.triage(view(spark, d))


@query("E3_order_verdicts", f"WITH {TRIAGE} SELECT doc_id, construct, verdict, confidence, section, statute_order, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, construct, statute_order) AS INTEGER) AS place FROM t")
def order_verdicts(spark, d):
    return statutes.order_verdicts(statutes.triage(view(spark, d)))


# --- remedies -----------------------------------------------------------------------------------
_SIGNALS = " UNION ".join(
    [f"SELECT doc_id, document_type, 'construct' AS kind, '{c}' AS detail FROM v WHERE {c}" for c in CONSTRUCTS]
    + ["SELECT doc_id, document_type, 'verdict', verdict FROM t JOIN v USING (doc_id)", "SELECT doc_id, document_type, 'risk_driver', severity FROM e JOIN v USING (doc_id) WHERE outcome"]
    + ["SELECT doc_id, document_type, 'problem', problem FROM s JOIN v USING (doc_id) WHERE problem IS NOT NULL"]
    + [f"SELECT doc_id, document_type, 'situation', '{f}' FROM s JOIN v USING (doc_id) WHERE {f}" for f in ("cannot_afford_lawyer", "prefers_settlement")]
    + [f"SELECT doc_id, document_type, 'universal', '{f[0]}' FROM v" for f in FORUMS if ("universal", f[0]) in f[3]]
)
_TRIGGERS = " UNION ALL ".join(
    f"SELECT '{f}' AS forum, {repr(rule) if rule else 'NULL'} AS limitation_id, '{kind}' AS kind, '{detail}' AS detail, "
    f"{'TRUE' if not types else repr(',' + ','.join(types) + ',')} AS types" .replace("TRUE AS types", "'' AS types")
    for f, rule, types, triggers in FORUMS for kind, detail in triggers
)
_ROUTES = (
    f"{E}, t AS ({_STATUTE_ROWS}), {S}, sig AS ({_SIGNALS}), trig AS ({_TRIGGERS}), routes AS (SELECT doc_id, forum, limitation_id, kind, detail FROM sig JOIN trig USING (kind, detail) "
    "WHERE kind NOT IN ('construct', 'verdict', 'risk_driver') OR types = '' OR contains(types, ',' || document_type || ','))"
)
_RULES = "lim AS (" + " UNION ALL ".join(f"SELECT '{i}' AS limitation_id, '{u}' AS unit, {n} AS n" for i, u, n, _ in LIMITATIONS) + ")"
_END = "CAST(CASE WHEN unit = 'months' THEN cause_date + to_months(CAST(n AS INTEGER)) ELSE cause_date + to_days(CAST(n AS INTEGER)) END AS DATE)"
_LEFT = f"date_diff('day', DATE '{derive.TODAY}', {_END})"
_URGENCY = f"CASE WHEN {_LEFT} < 0 THEN 'expired' WHEN {_LEFT} < 30 THEN 'urgent' WHEN {_LEFT} < 180 THEN 'act_soon' WHEN {_LEFT} IS NOT NULL THEN 'ample' END"
_PRIORITY = (
    f"{_ROUTES}, {_RULES}, per AS (SELECT doc_id, forum, limitation_id, count(*) FILTER (WHERE kind <> 'universal') AS facts, bool_or(kind = 'universal') AS open_to_all FROM routes GROUP BY ALL), "
    f"pri AS (SELECT doc_id, forum, facts, {_URGENCY} AS urgency, open_to_all FROM per LEFT JOIN lim USING (limitation_id) LEFT JOIN s USING (doc_id)), "
    "p AS (SELECT doc_id, forum, facts, urgency, CAST(CASE WHEN open_to_all THEN facts ELSE 10 * facts + CASE urgency WHEN 'urgent' THEN 3 WHEN 'act_soon' THEN 2 WHEN 'ample' THEN 1 ELSE 0 END END AS INTEGER) AS priority FROM pri)"
)
_STEPS = f"{_PRIORITY}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, forum) AS INTEGER) AS place FROM p)"


@query("M1_route_signals", f"WITH {_ROUTES} SELECT * FROM routes")
def route_signals(spark, d):
    return remedies.route_signals(view(spark, d), situations(spark, d))


@query("M2_add_months_clamped", f"WITH {S} SELECT doc_id, CAST(cause_date + to_months(CAST(doc_id % 48 AS INTEGER)) AS DATE) AS moved FROM s")
def add_months_clamped(spark, d):
    return situations(spark, d).select("doc_id", F.add_months("cause_date", (F.col("doc_id") % 48).cast("int")).alias("moved"))


_CLOCK = f"WITH {S}, {_RULES} SELECT doc_id, limitation_id, {_END} AS deadline, CAST({_LEFT} AS INTEGER) AS days_remaining, {_URGENCY} AS urgency FROM s CROSS JOIN lim WHERE cause_date IS NOT NULL"


@query("M3_limitation_clock", _CLOCK)
def limitation_clock(spark, d):
    return remedies.limitation_clock(situations(spark, d), derive.TODAY)


@query("M4_urgency", f"WITH x AS ({_CLOCK}) SELECT limitation_id, urgency, count(*) AS documents FROM x GROUP BY ALL")
def urgency(spark, d):
    return remedies.limitation_clock(situations(spark, d), derive.TODAY).groupBy("limitation_id", "urgency").agg(F.count(F.lit(1)).alias("documents"))


@query("M5_route_priority", f"WITH {_PRIORITY} SELECT * FROM p")
def route_priority(spark, d):
    return remedies.route_priority(view(spark, d), situations(spark, d), derive.TODAY)


@query("M6_next_steps", f"WITH {_STEPS} SELECT * FROM n")
def next_steps(spark, d):
    return remedies.next_steps(view(spark, d), situations(spark, d), derive.TODAY)


_STAGE_ROWS = "st AS (" + " UNION ALL ".join(f"SELECT '{i}' AS limitation_id, {p} AS place, {n} AS days, {label!r} AS label".replace('"drawer\'s time to pay"', "'drawer''s time to pay'") for i, p, n, label in STAGES) + ")"


@query("M7_staged_deadlines", f"WITH {S}, {_STAGE_ROWS} SELECT doc_id, limitation_id, place, CAST(cause_date + to_days(CAST(days AS INTEGER)) AS DATE) AS until FROM s CROSS JOIN st WHERE cause_date IS NOT NULL")
def staged_deadlines(spark, d):
    stages = remedies.staged_deadlines(spark).where("place is not null").select("limitation_id", "place", "days")
    per = situations(spark, d).where("cause_date is not null").select("doc_id", "cause_date", F.explode(F.array(*[F.lit(x) for x in sorted({s[0] for s in STAGES})])).alias("limitation_id"))
    return per.join(F.broadcast(stages), "limitation_id").select("doc_id", "limitation_id", "place", F.date_add("cause_date", F.col("days")).alias("until"))


_NEEDS = "need AS (" + " UNION ALL ".join(f"SELECT '{f}' AS forum, {s} AS step, {'NULL' if w is None else w} AS wait_days, '{what}' AS what" for f, s, w, what in PREREQUISITES) + ")"


@query("M8_prerequisites", f"WITH {_STEPS}, {_NEEDS} SELECT doc_id, forum, place, step, wait_days, what FROM n LEFT JOIN need USING (forum)")
def prerequisites(spark, d):
    return remedies.prerequisites(next_steps(spark, d))


# --- legal aid ----------------------------------------------------------------------------------
_AID = (
    f"pr AS ({derive.text(derive.PROFILES)}), ce AS ({derive.text(derive.CEILINGS)}), a AS (SELECT *, CASE WHEN supreme_court THEN {legal_aid.SUPREME_COURT} "
    f"ELSE coalesce(ce.ceiling, {legal_aid.FALLBACK}) END AS limit_ FROM pr LEFT JOIN ce USING (state)), "
    "b AS (SELECT applicant_id, CAST(limit_ AS DOUBLE) AS ceiling, concat_ws(',', " + ", ".join(f"CASE WHEN {g} THEN '{g}' END" for g in legal_aid.GROUNDS)
    + ") AS free, CASE WHEN income <= limit_ THEN 'income_below_ceiling' END AS paid, income FROM a), "
    "c AS (SELECT *, concat_ws(',', nullif(free, ''), paid) AS grounds FROM b)"
)


def _aid(spark, d):
    return derive.frame(spark, d, derive.PROFILES), derive.frame(spark, d, derive.CEILINGS)


@query("A1_income_ceiling", f"WITH {_AID} SELECT applicant_id, ceiling FROM c")
def income_ceiling(spark, d):
    return legal_aid.income_ceiling(*_aid(spark, d)).select("applicant_id", "ceiling")


@query("A2_eligibility", f"WITH {_AID} SELECT applicant_id, ceiling, grounds, grounds <> '' AS eligible, free <> '' AS qualifies_regardless, grounds = '' AND income IS NULL AS indeterminate FROM c")
def eligibility(spark, d):
    return legal_aid.eligibility(*_aid(spark, d)).withColumn("grounds", F.array_join("grounds", ","))


@query("A3_eligibility_summary", f"WITH {_AID}, x AS (SELECT unnest(string_split(grounds, ',')) AS ground FROM c WHERE grounds <> '') SELECT ground, count(*) AS applicants FROM x GROUP BY ground")
def eligibility_summary(spark, d):
    return legal_aid.eligibility_summary(*_aid(spark, d))
