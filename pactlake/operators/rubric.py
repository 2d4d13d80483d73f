"""Rule evaluation and risk scores (R7-R16). One pass over the fact view, no joins with the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions.predicates import compile_predicate
from pactlake.functions.spans import let
from pactlake.plans.rules import BANDS, EXPLANATIONS, NUMBERS, RULES, SATURATION, TIER_CAPS, inputs, question


def applies(rule: tuple) -> Column:
    return F.col("document_type").isin(*rule[4]) if rule[4] else F.lit(True)


def fired(rule: tuple) -> Column:
    return F.coalesce(applies(rule) & compile_predicate(rule[6]), F.lit(False))


def outcomes(rules: list[tuple] = RULES) -> Column:
    """One entry for each rule that applies, in rule order: true, false or null."""
    entries = [
        F.when(
            applies(r),
            F.struct(
                F.lit(i).alias("rule_order"), F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("tier"), F.lit(r[2]).alias("severity"),
                F.lit(r[3]).alias("points"), F.lit(r[5]).alias("evidence_from"), compile_predicate(r[6]).alias("outcome"),
            ),
        )
        for i, r in enumerate(rules)
    ]
    return F.array_compact(F.array(*entries))


def evaluate_rules(view: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Documents by applicable rules."""
    return view.select("doc_id", F.explode(outcomes(rules)).alias("r")).select("doc_id", "r.*")


def risk_drivers(view: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Rules that fired, with their evidence where ``evidence(doc_id, name, ...)`` has it."""
    drivers = evaluate_rules(view).where("outcome").drop("outcome")
    if evidence is None:
        return drivers
    return drivers.join(evidence.withColumnRenamed("name", "evidence_from"), ["doc_id", "evidence_from"], "left")


def fired_rules(hit=fired) -> Column:
    """An entry for each rule, null unless it fired (``hit``, as a rule's column). It needs no lambda, so Spark compiles it."""
    fields = lambda i, r: {"rule_order": i, "rule_id": r[0], "points": r[3], "severity": r[2], "evidence_from": r[5]}
    return F.array(*[F.when(hit(r), F.struct(*[F.lit(x).alias(c) for c, x in fields(i, r).items()])) for i, r in enumerate(RULES)])


def drivers_of(rules: Column, named: Column) -> Column:
    """R9 as an array, in rule order, of :func:`fired_rules` and the document's evidence (:func:`grounding.evidence_of`)."""

    def driver(r: Column) -> Column:
        own = F.array_max(F.filter(named, lambda n: n["name"] == r["evidence_from"]))
        return let(own, lambda n: F.struct(*[r[c].alias(c) for c in ("rule_order", "rule_id", "points", "severity")], n["start"].alias("start"), n["end"].alias("end")))

    return F.transform(F.array_compact(rules), driver)


def question_column(rule_id: str = "rule_id") -> Column:
    """The question that a rule asks, by its id."""
    return F.element_at(F.create_map(*[F.lit(x) for r in RULES for x in (r[0], question(r[0]))]), F.col(rule_id))


def unknown_questions(view: DataFrame) -> DataFrame:
    """Undecidable rules, with what the document does not say (numbers missing, constructs unclear)."""
    entries = []
    for r in RULES:
        names = inputs(r[6])
        missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
        entries.append(F.when(applies(r) & compile_predicate(r[6]).isNull(), F.struct(F.lit(r[0]).alias("rule_id"), F.lit(question(r[0])).alias("question"), missing.alias("missing"))))
    return view.select("doc_id", F.posexplode(F.array_compact(F.array(*entries))).alias("ord", "q")).select("doc_id", (F.col("ord") + 1).alias("number"), "q.*")


def tier_total(tier: str, hit=fired) -> Column:
    points = [F.when(hit(r), r[3]).otherwise(0) for r in RULES if r[1] == tier]
    return F.least(reduce(Column.__add__, points), F.lit(TIER_CAPS[tier]))


def tier_totals(view: DataFrame) -> DataFrame:
    """Capped points of the four tiers, zero where nothing fired."""
    return view.select("doc_id", *[tier_total(t).alias(t) for t in TIER_CAPS])


def score_of(raw: Column) -> Column:
    return F.floor(100 * (1 - F.exp(-raw / F.lit(float(SATURATION)))) + 0.5).cast("int")


def band_of(score: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for top, band in reversed(BANDS):
        out = F.when(score <= top, band).otherwise(out)
    return out


def top_drivers(n: int = 3) -> Column:
    """The n drivers with the most points, ties by id."""
    hits = F.filter(outcomes(), lambda r: F.coalesce(r["outcome"], F.lit(False)))
    keyed = F.transform(hits, lambda r: F.struct((-r["points"]).alias("minus"), r["rule_id"].alias("rule_id")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda r: r["rule_id"])


def score_documents(view: DataFrame) -> DataFrame:
    """One row per document; every document appears."""
    raw = reduce(Column.__add__, [F.col(t) for t in TIER_CAPS])
    totals = view.select("doc_id", "document_type", *[tier_total(t).alias(t) for t in TIER_CAPS], top_drivers().alias("top_drivers"))
    return (
        totals.withColumn("score", score_of(raw)).withColumn("band", band_of(F.col("score")))
        .select("doc_id", "document_type", *TIER_CAPS, "score", "band", F.array_join("top_drivers", ",").alias("top_drivers"))
    )


def grouped_number(value: Column) -> Column:
    """Indian grouping (12,34,567), at most two decimals, half up."""
    cents = F.floor(F.abs(value) * 100 + 0.5).cast("long")
    whole, rest = F.floor(cents / 100).cast("long").cast("string"), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0")
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    grouped = F.when(head == "", whole).otherwise(
        F.concat(F.regexp_replace(head, r"\B(?=(\d{2})+(?!\d))", ","), F.lit(","), F.substring(whole, F.length(whole) - 2, F.lit(3)))
    )
    decimals = F.regexp_replace(F.concat(F.lit("."), rest), r"\.?0+$", "")
    return F.concat(F.when((value < 0) & (cents > 0), "-").otherwise(""), grouped, decimals)


def render(template: str) -> Column:
    """A template's ``{field}`` places filled; null where a value is missing. Unknown fields are refused here."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        if name not in NUMBERS:
            raise ValueError(f"template names no field: {name!r}")
        parts += [F.lit(before), grouped_number(F.col(name))]
    return F.concat(*parts, F.lit(rest))


def render_explanations(view: DataFrame, template: str, rule_id: str) -> tuple[DataFrame, DataFrame]:
    """Rendered texts of the documents for which a rule fired, and those that lack a value."""
    rule = next(r for r in RULES if r[0] == rule_id)
    rows = view.where(fired(rule)).select("doc_id", F.lit(rule_id).alias("rule_id"), render(template).alias("text"))
    return rows.where("text is not null"), rows.where("text is null")




def explanations(view: DataFrame, templates: dict[str, str] = EXPLANATIONS) -> DataFrame:
    """R10 for all rules: ``doc_id, rule_id, text`` of every rule that fired; ``text`` is null where a value is missing."""
    texts = [F.when(fired(r), F.struct(F.lit(r[0]).alias("rule_id"), render(templates[r[0]]).alias("text"))) for r in RULES if r[0] in templates]
    return view.select("doc_id", F.explode(F.array_compact(F.array(*texts))).alias("x")).select("doc_id", "x.*")
