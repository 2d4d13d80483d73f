"""Legal-aid eligibility over a table of applicants (A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUPREME_COURT, FALLBACK = 500_000.0, 300_000.0
GROUNDS = ("scheduled_caste_or_tribe", "trafficking_or_begar_victim", "woman_or_child", "mental_illness_or_disability", "undeserved_want", "industrial_workman", "in_custody")


def income_ceiling(profiles: DataFrame, ceilings: DataFrame) -> DataFrame:
    """A1: the ceiling that applies to each applicant; Spark broadcasts the ceilings if they are small."""
    out = profiles.join(ceilings, "state", "left")
    return out.withColumn("ceiling", F.when(F.col("supreme_court"), SUPREME_COURT).otherwise(F.coalesce("ceiling", F.lit(FALLBACK))))


def eligibility(profiles: DataFrame, ceilings: DataFrame) -> DataFrame:
    """A2: grounds in order; a missing answer is not a no, so it leaves the case open."""
    known = income_ceiling(profiles, ceilings)
    grounds = F.array_compact(F.array(*[F.when(F.col(g), F.lit(g)) for g in GROUNDS]))
    by_income = F.when(F.col("income") <= F.col("ceiling"), F.array(F.lit("income_below_ceiling"))).otherwise(F.array().cast("array<string>"))
    return known.select(
        "applicant_id", "ceiling", F.concat(grounds, by_income).alias("grounds"),
        (F.size(grounds) > 0).alias("qualifies_regardless"), F.col("income").isNull().alias("no_income"),
    ).select(
        "applicant_id", "ceiling", "grounds", (F.size("grounds") > 0).alias("eligible"), "qualifies_regardless",
        ((F.size("grounds") == 0) & F.col("no_income")).alias("indeterminate"),
    )


def eligibility_summary(profiles: DataFrame, ceilings: DataFrame) -> DataFrame:
    """A3."""
    return eligibility(profiles, ceilings).select(F.explode("grounds").alias("ground")).groupBy("ground").agg(F.count(F.lit(1)).alias("applicants"))
