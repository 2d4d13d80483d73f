"""Report assembly (V1-V12) over findings, drivers and verdicts with their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.plans.rules import TIER_CAPS

CHALLENGED = ("likely_void", "likely_unenforceable_as_written", "cannot_oust_this_forum", "capped_by_statute")


def collapse_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per construct: the last row's content at the first row's position."""
    key = ["doc_id", "construct"]
    return verdicts.groupBy(*key).agg(F.max_by(F.struct("verdict", "confidence", "section", "start", "end"), "place").alias("v"), F.min("place").alias("place")).select(*key, "place", "v.*")


def clause_overlap_join(findings: DataFrame, others: DataFrame, order: str, keep: list[str], width: int = 512) -> DataFrame:
    """V1: the first driver or verdict whose place overlaps a finding's.

    Both sides stand in every bin of ``width`` characters that they touch and
    meet on document and bin, so that a document with many of both is dealt
    out; a pair counts in the first bin that both touch.
    """
    bins = lambda start, end: F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end) - 1) / width))
    own = findings.where("start is not null and end is not null").select("doc_id", "ord", "start", "end", F.explode(bins("start", "end")).alias("bin"))
    o = others.where("start is not null and end is not null").select("doc_id", F.struct(order, *keep).alias("hit"), F.col("start").alias("s"), F.col("end").alias("e"))
    o = o.select("*", F.explode(bins("s", "e")).alias("bin"))
    overlap = (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")) & (F.col("bin") == F.floor(F.greatest("start", "s") / width))
    first = own.join(o, ["doc_id", "bin"]).where(overlap).groupBy("doc_id", "ord").agg(F.min("hit").alias("hit"))
    return findings.join(first, ["doc_id", "ord"], "left").select(*findings.columns, *[F.col(f"hit.{k}").alias(k) for k in keep])


def favours() -> Column:
    """V3: how many of two things speak for the reader."""
    share = (F.col("obligation_on") == "counterparty").cast("int") + (F.col("benefits") == "you").cast("int")
    return F.when(share == 2, "you").when(share == 1, "both").otherwise("counterparty")


def why_it_matters() -> Column:
    """V4."""
    return F.coalesce("explanation", "plain_summary")


def clause_actions() -> Column:
    """V5: what to do about a clause."""
    asks = F.array_compact(F.array(
        F.when(F.col("question").isNotNull(), F.concat(F.lit("ask: "), F.col("question"))),
        F.when(F.col("section").isNotNull(), F.concat(F.lit("ask about "), F.col("section"))),
    ))
    return F.when(F.size(asks) == 0, F.array(F.lit("accept"))).otherwise(asks)


def clause_confidence() -> Column:
    """V6."""
    unsure = F.coalesce(F.col("method") == "fuzzy", F.lit(False)) | F.coalesce(F.col("confidence") == "low", F.lit(False))
    return F.when(unsure, "depends_on_your_state").otherwise("confident")


def risk_signal() -> Column:
    """V7: challenged before risky before favourable before standard."""
    return (
        F.when(F.col("verdict").isin(*CHALLENGED), "challenged").when(F.col("severity").isin("medium", "high", "critical"), "risky")
        .when(F.col("benefits") == "you", "favourable").otherwise("standard")
    )


def time_sensitive(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """V8: whether any step's clock is urgent or has run out."""
    per = steps.groupBy("doc_id").agg(F.bool_or(F.col("urgency").isin("urgent", "expired")).alias("time_sensitive"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("time_sensitive", F.lit(False)).alias("time_sensitive"))


def tier_bars(totals: DataFrame) -> DataFrame:
    """Tier totals as shares of the document's largest."""
    top = F.greatest(F.lit(1), *[F.col(t) for t in TIER_CAPS])
    return totals.select("doc_id", *[F.floor(F.col(t) * 100 / top + 0.5).cast("int").alias(t) for t in TIER_CAPS])


def clause_view(findings: DataFrame, drivers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """V1 and V3-V7 together: one row per grounded finding."""
    with_driver = clause_overlap_join(findings, drivers, "rule_order", ["rule_id", "severity", "question", "explanation"])
    both = clause_overlap_join(with_driver, collapse_verdicts(verdicts), "place", ["construct", "verdict", "confidence", "section"])
    return both.select(
        "doc_id", "ord", "category", "rule_id", "verdict", favours().alias("favours"), risk_signal().alias("signal"),
        clause_confidence().alias("certainty"), F.array_join(clause_actions(), "; ").alias("actions"),
    )


def assemble_report(docs: DataFrame, base: list[Column], children: dict[str, Column], grounding: Column, refusals: DataFrame) -> DataFrame:
    """One nested row per document; refused documents carry their reason instead.

    Everything is made of the document's own row in ``docs``, so that nothing is
    grouped, joined or sorted again: ``base`` is what is said once, each of
    ``children`` an array of structs in order (empty where a document has none),
    ``grounding`` the counts.
    """
    fixed = [F.lit("report").alias("kind"), F.lit(None).cast("string").alias("reason")]
    report = docs.select(*base, *fixed, *[F.coalesce(rows, F.array()).alias(name) for name, rows in children.items()], grounding.alias("grounding"))
    return report.unionByName(refusals.select("doc_id", F.lit("not_a_document").alias("kind"), "reason"), allowMissingColumns=True)


def question_pack(unknowns: DataFrame) -> DataFrame:
    """Numbered questions with what is missing."""
    return unknowns.select("doc_id", "number", "question", F.array_join("missing", ", ").alias("missing"))


