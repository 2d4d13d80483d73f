"""Contract tables derived from the TPC-H-like tables: one document per order.

Each statement is SQL that Spark and DuckDB both accept; ``{orders}`` and the
like are filled with DataFrames or with table names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pactlake.plans.rules import CONSTRUCTS, PROBLEMS

TODAY = "2001-08-01"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()

_ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty".split()


def words_sql(q: str) -> str:
    """Number words of 1 to 50."""
    ones = " ".join(f"WHEN {i + 1} THEN '{w}'" for i, w in enumerate(_ONES))
    tens = " ".join(f"WHEN {i + 2} THEN '{w}'" for i, w in enumerate(_TENS))
    return (
        f"(CASE WHEN {q} < 20 THEN CASE {q} {ones} END ELSE concat(CASE CAST(floor({q} / 10) AS INT) {tens} END, "
        f"CASE WHEN {q} % 10 > 0 THEN concat(' ', CASE {q} % 10 {ones} END) ELSE '' END) END)"
    )


_PICKS = ", ".join(
    f"max(CASE WHEN l_linenumber = {n} THEN {column} END) AS {name}{n}"
    for n in range(1, 8)
    for name, column in (("q", "l_quantity"), ("p", "l_extendedprice"), ("d", "l_discount"), ("t", "l_tax"))
)
LINES = f"SELECT l_orderkey AS k, {_PICKS} FROM {{lineitem}} GROUP BY l_orderkey"

_FIELDS = {
    "noticeDaysYouMustGive": "q1", "noticeDaysTheyMustGive": "q2 - 1", "cureDaysYouGet": "q3 - 1", "cureDaysTheyGet": "q4",
    "lockInMonths": "floor(q5 / 4)", "termMonths": "q6", "depositRefundDays": "q7", "paymentTermDays": "q6 * 2", "dataRetentionDays": "q3 * 60",
    "confidentialityMonths": "q4 * 2", "nonCompeteMonths": "q5 - 1", "monthlyRentInr": "floor(p1 / 10)", "securityDepositInr": "floor(p2 / 3)",
    "annualRentIncreasePercent": "round(t3 * 200)", "annualCtcInr": "floor(p4 * 10)", "bondAmountInr": "floor(p5 * 5)", "bondMonths": "q5",
    "principalInr": "floor(p6 * 10)", "annualInterestPercent": "q7", "processingFeePercent": "round(d1 * 100)",
    "prepaymentPenaltyPercent": "round(d2 * 100)", "latePaymentPercentPerMonth": "round(d6 * 100)", "liabilityCapInr": "floor(p7)",
}
_TYPE = (
    "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'rent_agreement' WHEN '2' THEN 'employment_offer' WHEN '3' THEN 'loan_agreement' "
    "WHEN '4' THEN 'freelance_contract' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'nda' WHEN 1 THEN 'privacy_policy' ELSE 'other' END END"
)


def presence_sql(k: int) -> str:
    """0 present, 1 absent, 2 unclear, 3 no row."""
    return f"((o_orderkey + 3) * ({k} + 5) * 13) % 17 % 4"


_WIDE = ", ".join(f"CAST({e} AS DOUBLE) AS {f}" for f, e in _FIELDS.items())
_FLAGS = ", ".join(f"CASE {presence_sql(k)} WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS {c}" for k, c in enumerate(CONSTRUCTS, 1))
#: The wide fact view: document type, 23 nullable numbers, 20 nullable constructs.
FACTS = f"SELECT o_orderkey AS doc_id, {_TYPE} AS document_type, {_WIDE}, {_FLAGS} FROM {{orders}} LEFT JOIN ({LINES}) ON o_orderkey = k"
#: Documents with their types only: they need no numbers of lines.
TYPES = f"SELECT o_orderkey AS doc_id, {_TYPE} AS document_type FROM {{orders}}"

_Q = {n: f"CAST(q{n} AS INT)" for n in range(1, 8)}
_P = {n: f"CAST(CAST(floor(p{n}) AS BIGINT) AS VARCHAR(20))" for n in (2, 7)}
_S = {n: f"CAST({_Q[n]} AS VARCHAR(9))" for n in range(1, 8)}
_SENTENCES = {
    1: f"concat('1. Either party may end this agreement by giving ', {words_sql(_Q[1])}, ' (', CAST({_Q[1]} + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)), ') days notice.')",
    2: f"concat('2. The security deposit is Rs. ', {_P[2]}, ' payable on signing.')",
    3: f"concat('3. The \"Lock-in Period\" means the first ', {_S[3]}, ' months of the term.')",
    4: f"concat('4. This is subject to Clause ', CAST({_Q[4]} % 9 + 1 AS VARCHAR(9)), ' and to the Lock-in Period.')",
    5: f"concat('5. Delayed sums carry interest at ', {_S[5]}, '% a year.')",
    6: f"concat('6. The tenant shall follow the \"Handover Protocol\" and give notice of ', {_S[6]}, ' days.')",
    7: f"concat('7. A refundable deposit of Rs. ', {_P[7]}, ' is held under Section 138 of the Sample Act.')",
}
_LINES_OF_TEXT = ", ".join(f"CASE WHEN q{n} IS NOT NULL THEN {s} END" for n, s in _SENTENCES.items())
#: Generated contract texts, one numbered line per line number.
CONTRACTS = f"SELECT k AS doc_id, concat_ws(chr(10), {_LINES_OF_TEXT}) AS text FROM ({LINES})"

#: The same texts with the dirt that canonicalisation removes.
RAW_CONTRACTS = (
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), concat(chr(13), chr(10))) WHEN 1 THEN concat('  ', replace(text, ' ', '  ')) "
    "WHEN 2 THEN replace(text, 'agreement', 'agree\u200bment') ELSE replace(text, 'payable', concat('pay-', chr(10), 'able')) END AS text "
    f"FROM ({CONTRACTS})"
)

_PROBLEM = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PROBLEMS, 1))
_SITUATION = (
    "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS cause_date, "
    f"CASE o_orderkey % 8 {_PROBLEM} END AS problem, o_orderkey % 3 = 0 AS cannot_afford_lawyer, o_orderkey % 5 = 0 AS prefers_settlement"
)
SITUATIONS = f"SELECT o_orderkey AS doc_id, {_SITUATION} FROM {{orders}}"

_AT = "CAST(1 + (doc_id * 7919 + ord * 104729) % greatest(1, length(text) - {0}) AS INT)"
_PARTIES = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(("you", "counterparty", "both")))
_GIVEN = {
    "category": "CASE (doc_id + ord) % 5 WHEN 0 THEN 'payment' WHEN 1 THEN 'termination' WHEN 2 THEN 'dispute_resolution' WHEN 3 THEN 'penalty' ELSE 'deposit' END",
    "obligation_on": f"CASE (doc_id * ord) % 4 {_PARTIES} ELSE 'unclear' END", "benefits": f"CASE (doc_id + 2 * ord) % 4 {_PARTIES} ELSE 'unclear' END",
}
_QUOTE = (
    f"CASE ord WHEN 1 THEN substring(text, {_AT.format(59)}, 60) WHEN 2 THEN upper(substring(text, {_AT.format(49)}, 50)) "
    f"WHEN 3 THEN substring(text, {_AT.format(11)}, 12) ELSE concat(reverse(substring(text, {_AT.format(39)}, 40)), 'zz') END"
)
#: Findings: four quotes of each contract, from places all over its text: as it stands, in capitals, too short, and backwards.
FINDINGS = (
    f"SELECT doc_id, ord, category, obligation_on, benefits, {_QUOTE} AS quote, ord = 2 AS is_unusual FROM (SELECT doc_id, text, ord, "
    + ", ".join(f"{e} AS {name}" for name, e in _GIVEN.items())
    + f" FROM ({CONTRACTS}) CROSS JOIN (SELECT 1 AS ord UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4))"
)
_ONE = "struct(ord, " + ", ".join(f"{e} AS {name}" for name, e in _GIVEN.items()) + f", {_QUOTE} AS quote, ord = 2 AS is_unusual)"
#: The same findings as an array beside the text of their contract, for Spark.
_ALL = "array(" + ", ".join(re.sub(r"\bord\b", str(k), _ONE).replace(f"struct({k}, ", f"struct({k} AS ord, ") for k in range(1, 5)) + ")"
NESTED_FINDINGS = f"SELECT doc_id, text, {_ALL} AS findings FROM ({CONTRACTS})"
#: All that is known of a document in one row, for Spark: facts, situation, text and findings. Lines are grouped once.
WHOLE = (
    f"SELECT o_orderkey AS doc_id, {_TYPE} AS document_type, {_WIDE}, {_FLAGS}, {_SITUATION}, text, findings FROM {{orders}} "
    f"LEFT JOIN (SELECT *, {_ALL} AS findings FROM (SELECT *, k AS doc_id, concat_ws(chr(10), {_LINES_OF_TEXT}) AS text FROM ({LINES}))) ON o_orderkey = k"
)
#: Of each contract a quote with one letter replaced, and the text, a fifth of them twice over, where the quote is ambiguous.
NEAR = (
    f"SELECT doc_id, 1 AS ord, concat(substring(text, {_AT.format(51).replace(' + ord * 104729', '')}, 20), '#', substring(text, {_AT.format(51).replace(' + ord * 104729', '')} + 21, 30)) AS quote, "
    f"CASE WHEN doc_id % 5 = 0 THEN concat(text, chr(10), text) ELSE text END AS text FROM ({CONTRACTS})"
)

PROFILES = (
    "SELECT c_custkey AS applicant_id, n_name AS state, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal * 50 END AS income, c_custkey % 11 = 0 AS supreme_court, "
    + ", ".join(f"CASE WHEN c_custkey % {m} = 1 THEN NULL ELSE c_custkey % {m} = 0 END AS {g}" for g, m in (
        ("woman_or_child", 13), ("scheduled_caste_or_tribe", 17), ("mental_illness_or_disability", 19), ("industrial_workman", 23),
        ("in_custody", 29), ("trafficking_or_begar_victim", 31), ("undeserved_want", 37)))
    + " FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey"
)
CEILINGS = "SELECT n_name AS state, CAST(100000 + n_nationkey * 10000 AS DOUBLE) AS ceiling FROM {nation} WHERE n_nationkey % 2 = 0"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The statement's result over the Parquet tables of ``sf_dir``."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def text(sql: str) -> str:
    """The statement for an engine that knows the tables by name."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
