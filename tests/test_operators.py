"""Behaviour of the contract operators on small rows."""

import datetime
import json
import pathlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pactlake import registry
from pactlake.functions import text as tx
from pactlake.functions.predicates import compile_predicate
from pactlake.functions.spans import match_spans
from pactlake.operators import canonical, consistency, grounding, legal_aid, remedies, report, rubric, statutes
from pactlake.plans import derive, score_queries, text_queries
from pactlake.plans.rules import BENCHMARKS, CONSTRUCTS, EXPLANATIONS, NUMBERS, QUESTIONS, RULES, inputs
from pactlake.sources import contracts as model_outputs
from pactlake.sources import files
from pactlake.streaming import guards

from .conftest import SF


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def contracts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n,d,expected", [(None, 0, None), (3, 0, True), (0, 0, None), (90, 30, True), (20, 30, False), (3, None, None)])
def test_ratio(spark, n, d, expected):
    row = spark.createDataFrame([(None if n is None else float(n), None if d is None else float(d))], "a double, b double")
    assert row.select(compile_predicate(("ratio_gte", "a", "b", 2)).alias("x")).first()["x"] is expected


def test_unknown_is_neither_true_nor_false(spark):
    row = spark.createDataFrame([(None, True, False)], "u boolean, t boolean, f boolean")
    present = lambda c: ("construct_present", c)
    table = {
        ("all_of", present("u"), present("f")): False, ("all_of", present("u"), present("t")): None, ("any_of", present("u"), present("t")): True,
        ("any_of", present("u"), present("f")): None, ("not", present("u")): None, ("construct_absent", "u"): None, ("construct_absent", "f"): True,
    }
    for p, expected in table.items():
        assert row.select(compile_predicate(p).alias("x")).first()["x"] is expected


def view(spark, **facts):
    types = {n: "double" for n in NUMBERS} | {c: "boolean" for c in CONSTRUCTS}
    schema = "doc_id long, document_type string, " + ", ".join(f"{k} {t}" for k, t in types.items())
    return spark.createDataFrame([(1, facts.pop("document_type", "other"), *[facts.get(k) for k in types])], schema)


def test_scores_and_bands(spark):
    empty = rubric.score_documents(view(spark)).first()
    assert (empty["score"], empty["band"], empty["top_drivers"]) == (0, "low", "")
    bad = rubric.score_documents(view(spark, **{c: True for c in CONSTRUCTS[:12]}, noticeDaysYouMustGive=90.0, noticeDaysTheyMustGive=30.0)).first()
    assert (bad["asymmetry"], bad["construct"]) == (18, 45) and bad["score"] == 75 and bad["band"] == "severe"
    assert bad["top_drivers"].split(",")[0] == "construct_self_help_remedy"
    assert one(spark, rubric.score_of(F.lit(84))) == 85


def test_unknowns_name_what_is_missing(spark):
    found = {r["rule_id"]: r["missing"] for r in rubric.unknown_questions(view(spark, noticeDaysYouMustGive=3.0)).collect()}
    assert found["notice_period_asymmetry_severe"] == ["noticeDaysTheyMustGive"] and found["construct_cross_default"] == ["cross_default"]


@pytest.mark.parametrize("value,expected", [(1234567.0, "12,34,567"), (999.5, "999.5"), (100000.0, "1,00,000"), (0.005, "0.01"), (7.0, "7"), (-1234.25, "-1,234.25"), (1234567890.0, "1,23,45,67,890")])
def test_grouped_numbers(spark, value, expected):
    assert one(spark, rubric.grouped_number(F.lit(value))) == expected


def test_templates_refuse_unknown_fields():
    with pytest.raises(ValueError):
        rubric.render("pays {salary}")


@pytest.mark.parametrize("phrase,expected", [("two hundred and fifty thousand", 250000), ("one hundred twenty", 120), ("two lakh fifty thousand only", 250000), ("crore", 10000000), ("thirty odd", None), ("and", None), ("", None), ("Fourty", 40)])
def test_number_words(spark, phrase, expected):
    assert one(spark, tx.number_words(F.lit(phrase))) == expected


@pytest.mark.parametrize("raw,expected", [("Rs. 1,50,000/-", 150000), ("₹ 2.5 lakh", 250000), ("INR 3 Cr", 3e7), ("Rupees 7 thousand only", 7000), ("only", None), ("-5", None), ("12 k", 12000), ("", None)])
def test_rupees(spark, raw, expected):
    assert one(spark, tx.rupees(F.lit(raw))) == expected


@pytest.mark.parametrize("window,value,start", [("not less than thirty (30) ", 30, 14), ("within sixty working ", 60, 7), ("pay 1,000.5 ", 1000.5, 4), ("nothing", None, None)])
def test_trailing_value(spark, window, value, start):
    found = one(spark, tx.trailing_value(F.lit(window)))
    assert (found and (found["value"], found["start"])) == (None if value is None else (value, start))


@pytest.mark.parametrize("times", [17, 3000])
def test_noise_run_is_linear(spark, times):
    assert one(spark, tx.trailing_value(F.lit("per " * times + "x"))) is None


def test_canonical_text(spark):
    dirty = "  A\r\nb  \t c­​\n\n\n\nre-\nimburse \r d  "
    assert one(spark, tx.canonical(F.lit(dirty))) == "A\nb c\n\nreimburse\nd"


def test_folding_agrees_with_its_offsets(spark):
    text = " “Hé”\n\n llo—W​orld İ "
    folded, offsets = tx.fold_with_offsets(text)
    assert one(spark, tx.folded(F.lit(text))) == folded and len(folded) == len(offsets) and folded.startswith('"hé" llo-world')
    assert text[offsets[folded.index("l")]] == "l"


def test_spans_have_code_point_offsets(spark):
    spans = one(spark, match_spans(F.lit("😀 12 and 345"), r"\d+"))
    assert [(s["start"], s["end"], s["text"]) for s in spans] == [(2, 4, "12"), (9, 12, "345")]
    assert one(spark, match_spans(F.lit("none"), r"\d+")) == []


def test_segments(spark):
    rows = canonical.find_segments(contracts(spark, "Title\n1. One\n1.1 Two\n(a) three\nIV. four\nSection 9. five", "plain")).collect()
    assert [(r["segment_id"], r["label"]) for r in rows] == [("seg-1-1", "1"), ("seg-2-1.1", "1.1"), ("seg-3-a", "(a)"), ("seg-5-9", "9")] or len(rows) == 5
    assert rows[0]["start"] == 6 and all(a["end"] == b["start"] for a, b in zip(rows, rows[1:]))


DOC = "1. The tenant shall give notice of thirty days to the owner of the flat.\n2. The deposit is refundable within sixty days of leaving."


@pytest.mark.parametrize("quote,status,detail", [
    ("notice of thirty days to the owner", "grounded", "exact"), ("NOTICE of  thirty days to the\nowner", "grounded", "normalised"),
    ("notice of thirty dxys to the owner", "grounded", "fuzzy"), ("zzzzqqqqzzzzqqqqzzzzqqqq", "unverified", "not_found"),
    ("notice", "unverified", "quote_too_short"), ("   ", "unverified", "quote_empty"), ("a landlord may keep every rupee without asking", "unverified", "below_threshold"),
])
def test_grounding(spark, quote, status, detail):
    quotes = spark.createDataFrame([(0, 1, quote)], "doc_id long, ord int, quote string")
    found = grounding.locate(quotes, contracts(spark, DOC)).first()
    assert found["status"] == status and detail in (found["method"], found["reason"])
    if status == "grounded":
        assert found["matched_text"] == DOC[found["start"] : found["end"]] and "thirty" in found["matched_text"]


def test_near_copies_are_ambiguous():
    clause = "the tenant shall give notice of thirty days"
    assert grounding.locate_fuzzy(clause + " ; " + clause, clause.replace("give", "gxve"))[0] == "ambiguous"
    assert grounding.locate_fuzzy(clause, clause.replace("give", "gxve"))[0] is None


FIVE = "\n".join([
    "1. Notice period is thirty (45) days for either party.", '2. The "Final Date" means the last day.', "3. See Clause 12 for the rest.",
    '4. The "Handover List" applies.', "5. The notice period shall be 60 days.",
])


def test_five_defects(spark):
    found = consistency.count_by_kind(contracts(spark, FIVE, "Nothing wrong here.")).orderBy("doc_id").collect()
    assert [found[0][k] for k in consistency.KINDS] == [1, 1, 1, 1, 1] and not any(found[1][k] for k in consistency.KINDS)


def test_references(spark):
    text = "1. a\n7.1 b\n2. under Clause 7 and Section 138 of the Sample Act, Clauses 9, 10 and 1, and Schedule A"
    assert sorted(r["label"] for r in consistency.dangling_references(contracts(spark, text)).collect()) == ["10", "9"]
    parent = "7. a\n8. see Clause 7.1 here\nAnnexure B\nand see Annexure C"
    assert sorted(r["label"] for r in consistency.dangling_references(contracts(spark, parent)).collect()) == ["7.1", "C"]


def test_a_month_is_thirty_days(spark):
    text = "1. Notice of one month is due.\n2. Notice of 30 days is due.\n3. Notice of two weeks is due."
    rows = consistency.conflicting_quantities(contracts(spark, text)).collect()
    assert [(r["value"], r["first_value"]) for r in rows] == [(14.0, 30.0)]


@pytest.mark.parametrize("start,months,expected", [("2024-01-31", 1, "2024-02-29"), ("2023-01-31", 1, "2023-02-28"), ("2024-02-29", 1, "2024-03-29"), ("2024-02-29", 12, "2025-02-28")])
def test_month_clamp(spark, start, months, expected):
    assert str(one(spark, remedies.deadline(F.lit(start).cast("date"), F.lit("months"), F.lit(months)))) == expected


@pytest.mark.parametrize("days,expected", [(-1, "expired"), (0, "urgent"), (29, "urgent"), (30, "act_soon"), (179, "act_soon"), (180, "ample"), (None, None)])
def test_urgency(spark, days, expected):
    assert one(spark, remedies.urgency(F.lit(days).cast("int"))) == expected


def test_routes_without_a_situation_are_the_universal_ones(spark):
    situations = spark.createDataFrame([], "doc_id long, cause_date date, problem string, cannot_afford_lawyer boolean, prefers_settlement boolean")
    assert [r["forum"] for r in remedies.next_steps(view(spark), situations, "2001-08-01").orderBy("place").collect()] == ["legal_services_authority", "lok_adalat"]


def test_missing_answer_is_not_a_no(spark):
    schema = "applicant_id long, state string, income double, supreme_court boolean, " + ", ".join(f"{g} boolean" for g in legal_aid.GROUNDS)
    none = [None] * len(legal_aid.GROUNDS)
    rows = [(1, "A", None, False, *none), (2, "A", 300000.0, False, *none), (3, "B", 9001.0, None, *none), (4, "B", None, True, True, *none[1:])]
    ceilings = spark.createDataFrame([("B", 9000.0)], "state string, ceiling double")
    found = {r["applicant_id"]: r for r in legal_aid.eligibility(spark.createDataFrame(rows, schema), ceilings).collect()}
    assert [found[i]["eligible"] for i in (1, 2, 3, 4)] == [False, True, False, True] and found[1]["indeterminate"] and not found[3]["indeterminate"]
    assert found[4]["qualifies_regardless"] and found[4]["ceiling"] == legal_aid.SUPREME_COURT


def test_rule_table_is_sound(spark):
    names = spark.createDataFrame([(n,) for n in [*NUMBERS, *CONSTRUCTS]], "name string")
    rules = text_queries.rule_table(spark)
    empty = spark.createDataFrame([], "forum string, limitation_id string")
    tiers = spark.createDataFrame([(t,) for t in ("asymmetry", "threshold", "construct", "absence")], "tier string")
    fine = spark.createDataFrame([("a", ["ask"])], "construct string, caveats array<string>")
    assert len(RULES) == 43 and text_queries.audit(rules, names, empty, empty.select("limitation_id"), tiers, fine).count() == 0
    bad = rules.limit(1).withColumn("rule_id", F.lit("Bad")).withColumn("weight", F.lit(51)).withColumn("inputs", F.array(F.lit("nope"))).withColumn("text_hi", F.lit(" "))
    forums = spark.createDataFrame([("f", "lost")], "forum string, limitation_id string")
    more, bare = tiers.union(spark.createDataFrame([("ghost",)], "tier string")), spark.createDataFrame([("b", [" "]), ("c", None)], "construct string, caveats array<string>")
    found = text_queries.audit(rules.unionByName(rules.limit(1)).unionByName(bad), names, forums, empty.select("limitation_id"), more, fine.union(bare)).collect()
    assert sorted({(r["problem"], r["at"]) for r in found} - {("duplicate_id", RULES[0][0])}) == [
        ("caveat", "b"), ("caveat", "c"), ("empty_table", "ghost"), ("foreign_key", "f"), ("id", "Bad"), ("text", "Bad"), ("unknown_name", "Bad:nope"), ("weight", "Bad"),
    ]


def test_rules_are_loaded_with_their_defaults(spark):
    loaded = {r["rule_id"]: r for r in text_queries._loaded_rules(spark).collect()}
    assert {k: (r["tier"], r["weight"], r["applies_to"], r["benchmark"]) for k, r in loaded.items()} == {r[0]: (r[1], r[3], list(r[4]), BENCHMARKS.get(r[0])) for r in RULES}
    assert len(BENCHMARKS) == 11


NESTED = "doc_id long, kind string, reason string, score int, drivers array<struct<rule_id:string,points:int>>, findings array<struct<ord:int,quote:string>>, tiers struct<absence:int>"


def nested(spark, rows):
    return spark.createDataFrame(rows, NESTED)


def test_store_counts_finished_runs_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, "report", None, i, [("r", 1)], [(1, "q")], (0,)) for i in range(10)] + [(10, "not_a_document", "no", None, None, None, None)]
    assert files.finished(spark, path).count() == 0
    done = files.finished(spark, path)
    files.write_reports(files.incremental_select(nested(spark, rows[:6]), done, done), path, "first")
    # A run that is killed between its reports and its manifest is not seen, and its ids are done again.
    nested(spark, rows[6:8]).withColumn("run", F.lit("killed")).write.mode("append").partitionBy("run").parquet(f"{path}/reports")
    kind = nested(spark, rows).schema.add("run", "string")
    assert {r["doc_id"] for r in files.read_reports(spark, path, kind).collect()} == set(range(6))
    done = files.finished(spark, path)
    files.write_reports(files.incremental_select(nested(spark, rows), done, done), path, "second")
    assert sorted((r["doc_id"], r["run"]) for r in files.read_reports(spark, path, kind).collect()) == [(i, "first" if i < 6 else "second") for i in range(11)]
    files.write_reports(nested(spark, rows[:2]), path, "second")  # a run that is run again replaces itself alone
    assert sorted((r["doc_id"], r["run"]) for r in files.read_reports(spark, path, kind).collect()) == sorted([*((i, "first") for i in range(6)), (0, "second"), (1, "second")])


def test_incremental_select_needs_reports_and_outputs(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    got = lambda **k: sorted(r["doc_id"] for r in files.incremental_select(ids(1, 2, 3, 4), ids(1, 2), ids(2, 3), **k).collect())
    assert got() == [1, 3, 4] and got(only=ids(2, 3, 9)) == [3] and got(force=True) == [1, 2, 3, 4] and got(force=True, only=ids(2)) == [2]


def test_a_changed_quote_deep_in_a_report_is_named_by_its_path(spark):
    old = [(1, "report", None, 5, [("a", 1)], [(1, "x"), (2, "y")], (3,)), (2, "report", None, 5, [], [], (3,)), (3, "not_a_document", "no", None, None, None, None)]
    new = [(1, "report", None, 5, [("a", 1)], [(1, "x"), (2, "z"), (3, "more")], (4,)), (2, "report", None, 5, [], [], (3,)), (4, "not_a_document", "no", None, None, None, None)]
    found = {tuple(r) for r in files.diff_reports(nested(spark, old), nested(spark, new)).collect()}
    assert found == {
        (1, "findings[1].quote", "y", "z"), (1, "findings[2].ord", None, "3"), (1, "findings[2].quote", None, "more"), (1, "tiers.absence", "3", "4"),
        (3, "kind", "not_a_document", None), (3, "reason", "no", None), (4, "kind", None, "not_a_document"), (4, "reason", None, "no"),
    }


def test_a_damaged_file_is_one_error_and_no_other_files_concern(spark, tmp_path):
    fine = json.dumps({"doc_id": 7, "kind": "report", "score": 3, "drivers": []}) + "\n" + json.dumps({"doc_id": 8, "kind": "not_a_document", "reason": "no"}) + "\n"
    cases = {
        "fine": fine, "cut": fine[:-9], "alien": '{"hello": 1}', "list": "[1, 2]", "no_score": '{"doc_id": 1, "kind": "report", "drivers": []}', "bad_id": '{"doc_id": -4, "kind": "not_a_document", "reason": "x"}',
        "no_id": '{"kind": "not_a_document", "reason": "x"}', "one_bad_line": fine + "{", "blank": " \n",
    }
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "utf16.json").write_bytes(fine.encode("utf-16"))
    (tmp_path / "empty.json").write_bytes(b"")
    good, bad = files.read_report_files(spark, str(tmp_path), NESTED)
    assert sorted((r["doc_id"], r["kind"]) for r in good.collect()) == [(7, "report"), (8, "not_a_document")]
    assert {r["path"].rsplit("/", 1)[1][:-5]: r["problem"] for r in bad.collect()} == {
        "cut": "malformed", "alien": "alien", "list": "alien", "no_score": "alien", "bad_id": "alien", "no_id": "alien", "one_bad_line": "malformed", "blank": "malformed", "utf16": "encoding",
    }


FINDING = {"id": "f1", "category": "deposit", "exactQuote": "q" * 24, "clauseLabel": None, "plainSummary": "ten letters", "obligationOn": "you", "benefits": "both", "isUnusual": False}
CLASS = {"isLegalDocument": True, "documentType": "nda", "language": "en", "notLegalReason": None, "confidence": "low"}
SAID = {"foundInDocument": False, "answer": "a", "exactQuote": None, "certainty": "implied"}


def facts(**changed):
    return {"documentType": "nda", "governingLawState": None, "jurisdictionCity": "Pune", **dict.fromkeys(NUMBERS), "constructs": [], "citations": []} | changed


@pytest.mark.parametrize("kind,record,expected", [
    ("findings", {"findings": [FINDING] * 60}, []), ("findings", {"findings": []}, []), ("findings", {"findings": [FINDING] * 61}, ["$.findings:too_many"]), ("findings", {}, ["$.findings:missing"]),
    ("findings", {"findings": [FINDING, FINDING | {"id": "f1234", "exactQuote": "q" * 23, "plainSummary": "p" * 401, "clauseLabel": 7, "isUnusual": "no", "benefits": "me", "category": None}]},
     ["$.findings[1].id:pattern", "$.findings[1].category:null", "$.findings[1].exactQuote:too_short", "$.findings[1].clauseLabel:type", "$.findings[1].plainSummary:too_long", "$.findings[1].benefits:choice", "$.findings[1].isUnusual:type"]),
    ("classification", CLASS, []), ("classification", CLASS | {"language": "fr", "notLegalReason": "r" * 201, "isLegalDocument": 1}, ["$.isLegalDocument:type", "$.language:choice", "$.notLegalReason:too_long"]),
    ("classification", {k: v for k, v in CLASS.items() if k != "notLegalReason"}, ["$.notLegalReason:missing"]),
    ("answer", SAID, []), ("answer", SAID | {"answer": "", "certainty": "sure", "exactQuote": "q" * 601}, ["$.answer:too_short", "$.exactQuote:too_long", "$.certainty:choice"]), ("answer", [], ["$:type"]), ("answer", None, ["$:null"]),
    ("facts", facts(), []), ("facts", facts(lockInMonths=1.5, noticeDaysYouMustGive=3650, annualRentIncreasePercent=0), []),
    ("facts", facts(lockInMonths=601, noticeDaysYouMustGive=1.5, noticeDaysTheyMustGive=-1, monthlyRentInr="much"), ["$.noticeDaysYouMustGive:integer", "$.noticeDaysTheyMustGive:too_small", "$.lockInMonths:too_large", "$.monthlyRentInr:type"]),
    ("facts", facts(citations=[{"field": "lockInMonths", "exactQuote": "q" * 12}, {"field": "rent", "exactQuote": "short"}], constructs=[{"construct": "cross_default", "presence": "maybe", "exactQuote": None}, 5]),
     ["$.constructs[0].presence:choice", "$.constructs[1]:type", "$.citations[1].field:choice", "$.citations[1].exactQuote:too_short"]),
    ("facts", facts(citations=[{"field": "lockInMonths", "exactQuote": "q" * 12}] * 41), ["$.citations:too_many"]), ("other", {}, [":kind"]),
])
def test_contracts_name_every_violation_by_its_path(spark, kind, record, expected):
    lines = spark.createDataFrame([(1, kind, json.dumps(record))], "doc_id long, kind string, json string")
    good, bad = model_outputs.validate_model_outputs(lines)
    assert [r["violations"] for r in bad.collect()] == ([expected] if expected else []) and good.count() == (not expected)


def test_records_that_do_not_parse_are_kept_raw(spark):
    lines = spark.createDataFrame([(i, "answer", t) for i, t in enumerate(['{"answer": "x"', "", None, json.dumps(SAID)])], "doc_id long, kind string, json string")
    good, bad = model_outputs.validate_model_outputs(lines)
    assert {r["doc_id"]: (r["json"], r["violations"]) for r in bad.collect()} == {0: ('{"answer": "x"', [":malformed"]), 1: ("", [":malformed"]), 2: (None, [":malformed"])}
    read = {r["doc_id"]: r["record"] for r in model_outputs.read_model_outputs(lines, "answer").collect()}
    assert [r["doc_id"] for r in good.collect()] == [3] and read[3]["certainty"] == "implied" and read[0] is read[1] is read[2] is None


def test_files_by_their_bytes(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.docx": b"PK\x03\x04\x14\x00\x00\x00word/document.xml", "c.docx": b"PK\x03\x04\x14\x00\x01\x00", "d.txt": b"ok", "e.txt": b"o\x00k", "f.txt": b"\xc3(", "g.txt": b"", "h.txt": b"%PDF-1.7"}.items():
        (tmp_path / name).write_bytes(data)
    inventory = spark.createDataFrame([(f"file:{f}", f.stat().st_size) for f in tmp_path.iterdir()], "path string, length long")
    found = {r["path"].rpartition("/")[2]: r["outcome"] for r in files.triage_files(files.read_files(spark, str(tmp_path), inventory)).collect()}
    assert found == {"a.pdf": "pdf", "b.docx": "docx", "c.docx": "rejected:encrypted", "d.txt": "text", "e.txt": "rejected:encoding", "f.txt": "rejected:encoding", "g.txt": "rejected:empty", "h.txt": "rejected:not_a_document"}


def events(spark, minutes):
    base = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("c", base + datetime.timedelta(minutes=m), i) for i, m in enumerate(minutes)], "client string, ts timestamp, event_id long")


def test_token_bucket(spark):
    rows = guards.throttle(events(spark, [0] * 13 + [1]), 12, 4.0).orderBy("event_id").collect()
    assert [r["allowed"] for r in rows] == [True] * 12 + [False, True] and rows[12]["retry_after"] == 15 and rows[13]["remaining"] == 3


def test_corpus_quote_search_finds_short_and_cut_quotes(spark):
    texts = {1: "the tenant shall pay all outstanding municipal taxes before leaving the house", 2: "short text", 3: "one", 4: ""}
    quotes = ["tenant shall pay all", "enant shall pay all outst", "nant shall pay all outstanding munic", "shall pay", "ort te", "one", "pay all outstanding municipal taxes before leaving the hou", "tenant must pay all", "hort text"]
    found = grounding.corpus_quote_search(spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"), spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    expected = {(d, q) for d, text in texts.items() for q, quote in enumerate(quotes) if quote in text}
    assert sorted((r["doc_id"], r["quote_id"]) for r in found.collect()) == sorted(expected)


def test_guards_do_not_hold_a_key_in_one_row(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [(c, base + datetime.timedelta(seconds=7 * i), i) for c in ("hot", "x", None) for i in range(300 if c == "hot" else 20)]
    batch = spark.createDataFrame(rows, "client string, ts timestamp, event_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        decided, reused = guards.throttle(batch), guards.dedup_ttl(batch, ["client"], 1)
        for found in (decided, reused):
            assert "collect_list" not in found._jdf.queryExecution().toString()
        decided, reused = decided.collect(), reused.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected, fresh = {}, {}
    for client in ("hot", "x", None):
        tokens, at, since = 12.0, None, None
        for _, ts, i in (r for r in rows if r[0] == client):
            tokens = min(12.0, tokens + (0 if at is None else (ts - at).total_seconds() * 4 / 60))
            at, expected[client, i] = ts, tokens >= 1
            tokens -= tokens >= 1
            fresh[client, i] = since is not None and (ts - since).total_seconds() < 60
            since = since if fresh[client, i] else ts
    assert {(r["client"], r["event_id"]): r["allowed"] for r in decided} == expected and not all(expected.values())
    assert {(r["client"], r["event_id"]): r["reused"] for r in reused} == fresh


def run_stream(spark, tmp_path, name, batches, transform):
    """The rows of a stream that reads one file per batch, and the progress of its last run."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        out = transform(spark.readStream.schema(batch.schema).parquet(str(tmp_path / name / "in")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        run_stream.progress = q.recentProgress
    return spark.read.parquet(str(tmp_path / name / "out"))


BASE = datetime.datetime(2024, 1, 1)


def minute(m):
    return BASE + datetime.timedelta(minutes=m)


@pytest.mark.parametrize("name,guard,twin", [
    ("bucket", lambda s: guards.throttle_stream(s, 3, 1 / 40, "30 minutes"), lambda b: guards.throttle(b, 3, 1 / 40)),
    ("reuse", lambda s: guards.dedup_stream(s, ["client"], 30, "30 minutes"), lambda b: guards.dedup_ttl(b, ["client"], 30)),
])
def test_guard_streams_equal_their_batch_twins(spark, tmp_path, name, guard, twin):
    """Rows out of order within the delay, over two runs that end by themselves; a late row is dropped; rows of the same time follow their ids."""
    rng = random.Random(8)
    order = sorted(range(60), key=lambda i: 7 * i + rng.uniform(0, 28))
    rows = [("abc"[i % 3], minute(7 * i if i % 9 else 7 * i - 7), i) for i in order]
    kind = "client string, ts timestamp, event_id long"
    late, closing = [("a", minute(1), 900), ("a", None, 901)], [("z", minute(9000), 999)]
    parts = [spark.createDataFrame(x, kind) for x in (rows[:25], rows[25:], closing, late)]
    found = run_stream(spark, tmp_path, name, parts, guard)
    whole = twin(parts[0].union(parts[1]))
    assert found.count() == 60 and found.exceptAll(whole.select(found.columns)).count() == 0
    assert len({tuple(r)[3] for r in found.collect()}) == 2  # both decisions occur
    assert sum(int(p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in run_stream.progress if p["stateOperators"]) == 1


def test_suppression_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [(i % 2, minute(9 * i), i, (60 if i % 5 == 0 else 10) if i % 5 in (0, 2) else None) for i in range(30)]
    random.Random(2).shuffle(rows)
    kind = "pair long, ts timestamp, event_id long, ttl_minutes int"
    parts = [spark.createDataFrame(x, kind) for x in (rows[:11], rows[11:], [(7, minute(9000), 99, None)])]
    found = run_stream(spark, tmp_path, "ban", parts, lambda s: guards.suppression_stream(s, "5 hours"))
    twin = guards.suppression(parts[0].union(parts[1]))
    assert found.count() == 18 and found.exceptAll(twin.select(found.columns)).count() == 0 and {r["skipped"] for r in found.collect()} == {True, False}


def test_guards_forget_idle_keys(spark, tmp_path):
    """After the watermark has passed what a key remembers, its state, its waiting rows and its timers are gone."""
    parts = [spark.createDataFrame(x, "client long, ts timestamp, event_id long") for x in ([(i, minute(i % 5), i) for i in range(200)], [(-1, minute(600), 998)], [(-1, minute(1200), 999)])]
    run_stream(spark, tmp_path, "idle", parts, lambda s: guards.throttle_stream(s, 3, 1 / 10, "1 minute"))
    for table in ("state", "waiting"):
        held = spark.read.format("statestore").option("path", str(tmp_path / "idle" / "state")).option("stateVarName", table).load()
        assert {r["key"][0] for r in held.select("key").collect()} <= {-1}, table


def test_suppression_blocks_equal_one_window(spark):
    """Few pairs with long histories, rows of the same time, and rows without a time: two levels give what one window gives."""
    rng = random.Random(12)
    rows = [(rng.choice([None, 0, 1]), None if rng.random() < 0.02 else minute(rng.randrange(3000)), i, rng.choice([None, None, 5, 90, 700])) for i in range(3000)]
    events = spark.createDataFrame(rows, "pair long, ts timestamp, event_id long, ttl_minutes int")
    expected = []
    for pair in (None, 0, 1):
        until = None
        for _, ts, i, ttl in sorted((r for r in rows if r[0] == pair), key=lambda r: (r[1] is not None, r[1] or BASE, r[2])):
            if ttl is None:
                expected.append((i, until is not None and ts is not None and ts < until))
            elif ts is not None:
                until = max(until or ts, ts + datetime.timedelta(minutes=ttl))
    found = guards.suppression(events, block_minutes=20)
    assert sorted((r["event_id"], r["skipped"]) for r in found.collect()) == sorted(expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(pair#\d+L?, block#\d+L", plan)
    assert dealt and events.where("pair = 0").select(F.floor(F.unix_micros("ts") / 1_200_000_000)).distinct().count() > 100  # so many groups of one pair


def test_redeem_join_deals_out_a_hot_token(spark):
    """One token with thousands of puts: the join's keys hold the slice, and its rows are those of all pairs."""
    puts = spark.range(4000).select(F.col("id").alias("put_id"), (F.lit(BASE) + F.make_dt_interval(mins=F.col("id"))).alias("put_ts"), F.lit(1).alias("token"), F.lit(2).alias("report_id"))
    reads = spark.range(900).select(F.col("id").alias("read_id"), (F.lit(BASE) + F.make_dt_interval(mins=F.col("id") * 5, secs=F.lit(30))).alias("read_ts"), F.lit(1).alias("token"), (F.col("id") % 2 + 1).alias("report_id"))
    found = guards.redeem_join(puts, reads)
    expected = {(p, r) for r in range(900) if r % 2 for p in range(max(0, 5 * r - 14), 5 * r + 1) if p < 4000}
    pairs = [(r["put_id"], r["read_id"]) for r in found.collect()]
    assert set(pairs) == expected and len(pairs) == len(expected)
    per_key = puts.withColumn("slice", F.floor(F.unix_micros("put_ts") / 900_000_000)).groupBy("slice").count().agg(F.max("count")).first()[0]
    assert per_key <= 15 and "__slice" in found._jdf.queryExecution().executedPlan().toString()


def test_interval_join_and_metrics_streams_equal_their_batch_twins(spark, tmp_path):
    reasons = [None, None, "ingest", "quota", "model", "unknown", "something else"]
    log = spark.createDataFrame([(minute(11 * i), "abc"[i % 3], i, reasons[i % 7]) for i in range(40)] + [(minute(9 * 1440), "a", 1, None)], "ts timestamp, document_type string, score int, failure string")
    found = run_stream(spark, tmp_path, "metrics", [log], lambda s: guards.analysis_metrics(s, streaming=True))
    twin = guards.analysis_metrics(log.where("ts < '2024-01-05'"))
    assert found.exceptAll(twin).count() == 0 and found.count() == twin.count()
    total = twin.agg(*[F.sum(c).alias(c) for c in twin.columns if c.startswith(("failed", "analyses"))]).first().asDict()
    assert total == {"analyses": 12, "failed_ingest": 6, "failed_quota": 6, "failed_model": 6, "failed_unknown": 10}
    puts = spark.createDataFrame([(1, minute(0), 1, 1), (2, minute(20), 1, 1)], "put_id long, put_ts timestamp, token long, report_id long")
    reads = spark.createDataFrame([(5, minute(14), 1, 1), (6, minute(21), 1, 1), (7, minute(36), 1, 1), (8, minute(9000), 9, 9)], "read_id long, read_ts timestamp, token long, report_id long")

    def join(s):
        puts_ = spark.readStream.schema(puts.schema).parquet(str(tmp_path / "puts"))
        return guards.redeem_join(puts_, s, streaming=True)

    puts.write.parquet(str(tmp_path / "puts"))
    found = run_stream(spark, tmp_path, "redeem", [reads], join)
    assert sorted((r["put_id"], r["read_id"]) for r in found.collect()) == [(1, 5), (2, 6)]


def test_oversized_files_are_reported_and_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_BYTES", 100)
    (tmp_path / "a.txt").write_bytes(b"fine")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-" + b"x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        found = {r["path"].rsplit("/", 1)[1]: r["outcome"] for r in files.triage_files(files.read_files(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == {"a.txt": "text", "b.pdf": "rejected:too_large"}


def test_texts_without_findings_and_quotes_without_text_stay(spark):
    docs = spark.createDataFrame([(1, "a text without any finding"), (2, "the tenant shall pay the rent on time")], "doc_id long, text string")
    quotes = spark.createDataFrame([(2, 1, "tenant shall pay the rent on", "payment"), (9, 1, "a quote whose document is nowhere", "payment"), (9, 2, None, "payment")], "doc_id long, ord int, quote string, category string")
    found = grounding.verify_findings(quotes, docs)
    assert sorted((r["doc_id"], r["ord"], r["status"], r["reason"], r["start"]) for r in found.collect()) == [(2, 1, "grounded", None, 4), (9, 1, "unverified", "not_found", None), (9, 2, "unverified", "quote_empty", None)]
    pieces = grounding.highlight_spans(found, docs).orderBy("doc_id", "start").collect()
    assert [tuple(r) for r in pieces] == [(1, 0, 26, None), (2, 0, 4, None), (2, 4, 32, 1), (2, 32, 37, None)]
    stats = {r["doc_id"]: r for r in grounding.grounding_stats(found).collect()}
    assert stats[9]["not_found"] == stats[9]["quote_empty"] == 1 and stats[2]["exact"] == 1


def test_window_scores_equal_brute_force():
    rng = random.Random(6)
    document, quote = "".join(rng.choice("abc ") for _ in range(300)), "".join(rng.choice("abc ") for _ in range(30))

    def dice(a, b):
        x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
        return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)

    scores = [dice(document[p : p + 30], quote) for p in range(270)]
    for table in (1 << 20, 0):  # running sums, and places
        at, score = grounding._Windows(grounding._Document(document), quote, table).best(0, 269, 1)
        assert score == pytest.approx(max(scores)) and at == max(range(270), key=lambda p: (round(scores[p], 12), -p))


def test_a_text_meets_all_its_quotes_at_once(spark):
    """Hundreds of quotes of one document: one row of the join and of the search, and what each quote alone gets."""
    rng = random.Random(9)
    text = " ".join(rng.choice("rent deposit notice tenant owner shall pay within thirty days of the term".split()) + rng.choice(["", "", ","]) for _ in range(400))
    near = lambda t: t[:20] + "#" + t[21:]
    rows = []
    for i in range(200):
        at = rng.randrange(len(text) - 60)
        piece = text[at : at + rng.randrange(30, 60)]
        rows.append((rng.choice([1, 2]), i, [piece, piece.upper(), near(piece), piece[:9], piece[::-1], ""][i % 6], f"tag{i}"))
    docs = spark.createDataFrame([(1, text), (2, text[:700]), (3, "never asked")], "doc_id long, text string")
    quotes = spark.createDataFrame(rows, "doc_id long, ord int, quote string, category string")
    assert grounding._bundled(quotes, docs).count() == 2
    found = grounding.locate(quotes, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("ArrowEvalPython") == 1
    texts = {1: text, 2: text[:700]}
    for r in found.collect():
        quote, own = tx_trim(rows[r["ord"]][2]), texts[r["doc_id"]]
        if quote == "" or len(quote) < 24:
            expected = ("quote_empty" if quote == "" else "quote_too_short", None, None)
        elif quote in own:
            expected = (None, "exact", own.index(quote))
        else:
            reason, start, _, method, _ = grounding._search_all(own, [quote])[0]
            expected = (reason, method, start)
        assert (r["reason"], r["method"], r["start"]) == expected and r["category"] == f"tag{r['ord']}"
    assert {r["method"] for r in found.collect()} == {None, "exact", "normalised", "fuzzy"}


def tx_trim(text):
    return text.strip(" \n")


def test_places_of_a_document_with_many_segments_take_linear_time(spark):
    """50,000 segments and as many offsets of one document: a join on the document alone compares 2.5 billion pairs."""
    segments = spark.range(50_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 9).alias("end"), F.col("id").alias("segment_id"))
    offsets = spark.range(50_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 7919 % 500_000).alias("offset")).unionAll(spark.createDataFrame([(2, 5), (None, 5), (1, None), (1, -3)], "doc_id int, offset long"))
    began = time.monotonic()
    rows = canonical.place_at(offsets, segments, ["segment_id"]).collect()
    assert time.monotonic() - began < 30 and len(rows) == 50_004
    for r in rows:
        inside = r["doc_id"] == 1 and r["offset"] is not None and r["offset"] >= 0 and r["offset"] % 10 < 9
        assert r["segment_id"] == (r["offset"] // 10 if inside else None)


def test_overlaps_of_a_document_with_many_clauses_are_dealt_out(spark):
    """Intervals of all lengths, empty ones too, against all pairs; the join's keys hold the bin."""
    rng = random.Random(3)
    spans = lambda n: [(1, i, (a := rng.randrange(6000)), a + rng.choice([0, 3, 40, 900])) for i in range(n)]
    findings, others = spans(300), spans(300)
    f = spark.createDataFrame(findings + [(1, 999, None, None)], "doc_id long, ord int, start int, end int")
    o = spark.createDataFrame([(d, i, f"r{i}", s, e) for d, i, s, e in others] + [(1, 999, "none", None, None)], "doc_id long, rule_order int, rule_id string, start int, end int")
    found = report.clause_overlap_join(f, o, "rule_order", ["rule_id"], width=64)
    for r in found.collect():
        hits = [i for _, i, s, e in others if r["start"] is not None and s < r["end"] and r["start"] < e]
        assert r["rule_id"] == (f"r{min(hits)}" if hits else None)
    assert re.search(r"hashpartitioning\(doc_id#\d+L?, bin#\d+L|\[doc_id#\d+L?, bin#\d+L\]", found._jdf.queryExecution().executedPlan().toString())


def test_corpus_search_scans_the_corpus_once_and_takes_any_number_of_bare_quotes(spark, monkeypatch):
    monkeypatch.setattr(grounding, "_NEEDLES", 7)
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta rho sigma tau".split())
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(80)] + ["", None]
    asked = [texts[i % 80][3 : 3 + rng.randrange(2, 40)] for i in range(60)] + ["alp", "a b", "", None, "MMA  Delta", "zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quotes = spark.createDataFrame(list(enumerate(asked)), "quote_id long, quote string")
    low = lambda t: " ".join((t or "").lower().split())
    expected = {(i, j, low(t).index(low(q))) for i, t in enumerate(texts) for j, q in enumerate(asked) if low(q) and low(q) in low(t)}
    found = [tuple(r) for r in grounding.corpus_quote_search(quotes, docs).collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_folding_of_long_texts_takes_little_time():
    text = ("The “tenant’s” rent – due\u200b  \n" * 20_000)[:400_000]
    tx.fold_with_offsets(text)  # makes the tables
    began = time.process_time()
    low, offsets = tx.fold_with_offsets(text)
    assert time.process_time() - began < 0.13 and len(low) == len(offsets)
    assert all(text[o].lower() == c or c in "'\"-\u0020" for c, o in zip(low[:300], offsets))


def test_many_matches_take_linear_time(spark):
    text = "12, " * 50_000
    row = spark.createDataFrame([(text,)], "text string").select(match_spans(F.col("text"), r"\d+").alias("m")).select(F.size("m").alias("n"), F.element_at("m", -1).alias("last")).first()
    assert row["n"] == 50_000 and tuple(row["last"]) == (199_996, 199_998, "12")


def test_every_rule_has_a_text_of_its_own_numbers():
    assert set(EXPLANATIONS) == {r[0] for r in RULES} and set(QUESTIONS) | set(BENCHMARKS) <= set(EXPLANATIONS)
    for rule in RULES:
        assert set(re.findall(r"\{(\w+)\}", EXPLANATIONS[rule[0]])) <= set(inputs(rule[6]))


def test_evidence_falls_back_to_the_first_finding_of_the_category(spark):
    verdicts = spark.createDataFrame([(1, "self_help_remedy", "x"), (1, "post_employment_non_compete", "y"), (2, "cross_default", "z")], "doc_id long, construct string, verdict string")
    evidence = spark.createDataFrame([(1, "self_help_remedy", 5, 9)], "doc_id long, name string, start int, end int")
    findings = spark.createDataFrame([(1, 2, "restraint_of_trade", 30, 40), (1, 1, "restraint_of_trade", 50, 60)], "doc_id long, ord int, category string, start int, end int")
    found = {r["construct"]: (r["start"], r["end"]) for r in statutes.with_evidence(verdicts, evidence, findings).collect()}
    assert found == {"self_help_remedy": (5, 9), "post_employment_non_compete": (50, 60), "cross_default": (None, None)}


def test_hits_do_not_extend_their_age(spark):
    rows = guards.dedup_ttl(events(spark, [0, 20, 29, 30, 45]), ["client"]).orderBy("event_id").collect()
    assert [r["reused"] for r in rows] == [False, True, True, False, True]


def test_clause_overlap_takes_the_first(spark):
    findings = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 20, 30)], "doc_id long, ord int, start int, end int")
    drivers = spark.createDataFrame([(1, 2, "b", 5, 8), (1, 1, "a", 9, 12), (1, 0, "c", 10, 20)], "doc_id long, rule_order int, rule_id string, start int, end int")
    found = report.clause_overlap_join(findings, drivers, "rule_order", ["rule_id"]).orderBy("ord").collect()
    assert [r["rule_id"] for r in found] == ["a", None]


def test_registry_and_flagship(spark):
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)
    assert registry.QUERIES[registry.FLAGSHIP](spark, SF).count() == 1500
    assert derive.frame(spark, SF, derive.CONTRACTS).count() == 1473 and score_queries.view(spark, SF).count() == 1500


def test_legal_gate_query(spark):
    rows = {r["doc_id"]: (r["document_type"], r["reason"]) for r in text_queries.QUERIES["P5_legal_gate"](spark, SF).collect()}
    refused = {k: reason for k, (kind, reason) in rows.items() if reason is not None}
    assert set(refused) == {k for k in rows if k % 13 == 0} and all((v == "receipt") == (k % 26 == 0) for k, v in refused.items())
    assert all(kind is None if k in refused else kind == "nda" or k % 3 for k, (kind, _) in rows.items())


def test_dice_shuffles_no_character_pairs(spark):
    """Many quotes of one document, pairs that repeat, short and empty sides; no pair leaves its row."""
    text = "aaaa bbb \U0001F600\U0001F600 the end of the aaaa"
    quotes = [(1, i, q) for i, q in enumerate(["aaa", "a", "", text, "zz", "\U0001F600\U0001F600the", None] + [text[i % 9 : i % 9 + 6] for i in range(600)])] + [(2, 0, "ab")]
    docs = spark.createDataFrame([(1, text), (2, "b"), (3, "lonely")], "doc_id long, b string")
    found = grounding.bigram_dice(spark.createDataFrame(quotes, "doc_id long, ord int, a string"), docs)
    assert "gram" not in found._jdf.queryExecution().optimizedPlan().toString()
    grams = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
    want = {(1, i): None if q is None else 1.0 if q == text else 0.0 if len(q) < 2 else 2 * sum((grams(q) & grams(text)).values()) / (len(q) + len(text) - 2) for k, i, q in quotes if k == 1} | {(2, 0): 0.0}
    assert {(r["doc_id"], r["ord"]): r["similarity"] for r in found.collect()} == want


def test_hopeless_quotes_cost_no_window_search(spark, monkeypatch):
    """A quote whose pairs the text has not is settled without windows; what is left has the outcome of a full search."""
    text = "Either party may end this agreement\tby giving  thirty days notice. " * 3
    monkeypatch.setattr(grounding, "_Windows", None)
    backwards = text[::-1][5:60]
    assert [r[0] for r in grounding._search_all(text, [backwards, "0123456789" * 4, text.upper()[3:40]])] == ["below_threshold", "not_found", None]
    monkeypatch.undo()
    assert grounding._search_all(text, ["giving thirty days"])[0][:3] == (None, text.index("giving"), text.index("days") + 4)


def test_spans_are_found_in_one_pass(spark):
    """Texts that hold the mark, empty matches, anchors and lookarounds; segments do not search the text once for each segment."""
    texts = ["1. one\n2) two\n(a) three\nclause 4.1 four\nIV. five", "\x01 1. x \x01\n2. y\x01", "", "no match", "\n\n10.2.3 a\n(iv) b"]
    for pattern in (r"(?m)^\d\.", r"\d*", r"(?<=\()[a-z]+(?=\))", consistency.ANY_CONCEPT, canonical.SEGMENT):
        for text in texts:
            got = [(m["start"], m["end"], m["text"]) for m in one(spark, match_spans(F.col("t"), pattern), t=text)]
            if pattern != r"\d*":
                flags = pattern if pattern.startswith("(?") else pattern
                assert got == [(m.start(), m.end(), m.group()) for m in re.finditer(flags, text) if m.group()], (pattern, text)
            assert all(text[a:b] == t for a, b, t in got)
    labels = [[s["label"] for s in one(spark, canonical.segments_of(F.col("t")), t=text)] for text in texts]
    assert labels == [["1", "2", "(a)", "4.1", "IV."], ["2"], [], [], ["10.2.3", "(iv)"]]
    plan = contracts(spark, "1. a").select(canonical.segments_of(F.col("text")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Clause".lower()) <= 4  # the pattern of a segment: the search, its twin for marked texts, and the label


def test_report_files_are_read_by_line(spark, tmp_path):
    """A file is as many rows as it has lines; its last bad line is its whole concern, and the worst one names it."""
    line = json.dumps({"doc_id": 7, "kind": "not_a_document", "reason": "no"})
    (tmp_path / "good.json").write_text((line + "\n\n") * 500)
    (tmp_path / "late.json").write_bytes((line + "\n").encode() * 500 + b"{}\n{\n\xff\xfe\n")
    (tmp_path / "two.json").write_text("{}\n{\n")
    good, bad = files.read_report_files(spark, str(tmp_path), "doc_id long, kind string, reason string, score int, drivers array<string>")
    assert "binaryFile" not in good._jdf.queryExecution().analyzed().toString() and good.count() == 500
    assert {r["path"].rsplit("/", 1)[1]: r["problem"] for r in bad.collect()} == {"late.json": "encoding", "two.json": "malformed"}


def test_last_assertion_without_strings_in_sums(spark):
    rows = [(1, 1, "a", "present", "q", True), (1, 2, "a", "absent", None, False), (1, 3, "b", "present", "q", False), (2, 1, "a", "present", " ", None), (2, 9, "b", "absent", "q", True), (2, 10, "b", None, "q", True), (3, 1, "a", "maybe", "q", True)]
    asserted = spark.createDataFrame(rows, "doc_id long, ord int, construct string, presence string, quote string, located boolean")
    found = grounding.fact_view_constructs(asserted, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long"), ["a", "b"])
    assert {r["doc_id"]: (r["a"], r["b"]) for r in found.collect()} == {1: ("absent", "unclear"), 2: ("present", "unclear"), 3: ("unclear", "unclear"), 4: ("unclear", "unclear")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan


def test_clauses_search_quotes_once(spark, monkeypatch):
    searches, search = [], grounding.locate
    monkeypatch.setattr(grounding, "locate", lambda *a: searches.append(1) or search(*a))
    text_queries._clauses(spark, SF)
    assert len(searches) == 1


def test_fuzzy_searches_of_a_batch_are_made_together(monkeypatch):
    """All quotes of a batch in one pass over running sums, with what each has alone; no table of windows is made for one quote."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randrange(0, 200))) for _ in range(400)] + ["ab" * 40, "", "a", "the same text twice; " * 4]
    quotes = []
    for text in texts:
        at = rng.randrange(max(1, len(text) - 40))
        piece = list(text[at : at + rng.randrange(2, 60)]) + ["a", "b"]
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = rng.choice("abz")
        quotes.append("".join(piece))
    alone = [grounding.locate_fuzzy(text, quote) for text, quote in zip(texts, quotes)]
    monkeypatch.setattr(grounding, "_Windows", None)
    together = grounding._fuzzy_all(texts, quotes)
    assert [(r, a if r is None else None, s if r is None else None) for r, a, s in together] == [(r, a if r is None else None, s if r is None else None) for r, a, s in alone]
    assert {r[0] for r in together} >= {None, "not_found", "below_threshold"}
    clause = "either party may end this agreement by giving thirty days notice"
    near = clause.replace("give", "gxve").replace("giving", "gxving")
    assert [r[0] for r in grounding._fuzzy_all([clause, clause + " ; " + clause], [near, near])] == [None, "ambiguous"]


def test_quotes_beside_their_text_need_no_join(spark):
    rows = text_queries._near_quotes(spark, SF).where("doc_id < 200")
    found = grounding.locate_beside(rows)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    joined = grounding.locate(rows.select("doc_id", "ord", "quote"), rows.select("doc_id", "text"))
    assert sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))


def test_findings_nested_beside_their_text_need_no_join(spark):
    nested = text_queries.nested_quotes(spark, SF).where("doc_id < 200")
    found = grounding.locate_nested(nested)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    joined = grounding.locate(text_queries.quotes(spark, SF).where("doc_id < 200"), text_queries.contracts(spark, SF))
    assert found.columns == joined.columns and sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))


def test_whole_records_are_checked_without_variants_and_lines_are_checked_once(spark, monkeypatch):
    names, store = [], model_outputs.stored
    monkeypatch.setattr(model_outputs, "stored", lambda rows, name: names.append(name) or store(rows, name))
    odd = [FINDING, {k: v for k, v in FINDING.items() if k != "clauseLabel"}, FINDING | {"clauseLabel": None, "plainSummary": "short"}]
    lines = spark.createDataFrame([(0, "findings", json.dumps({"findings": odd[::2]})), (1, "findings", json.dumps({"findings": odd}))], "doc_id long, kind string, json string")
    good, bad = model_outputs.validate_model_outputs(lines)
    assert names == ["checked-outputs"] and good.count() == 0
    broken = {r["doc_id"]: r["violations"] for r in bad.collect()}
    assert broken == {0: ["$.findings[1].plainSummary:too_short"], 1: ["$.findings[1].clauseLabel:missing", "$.findings[2].plainSummary:too_short"]}
    whole = F.col("as_findings").isNotNull() & model_outputs._there(model_outputs.FINDINGS, F.col("as_findings"))
    assert {r["doc_id"] for r in model_outputs._sound(lines).where(whole).collect()} == {0}


def test_a_line_is_parsed_once_for_all_fields_of_its_record(spark):
    lines = spark.createDataFrame([(1, "answer", json.dumps(SAID))], "doc_id long, kind string, json string")
    record = model_outputs.read_model_outputs(lines, "answer").where("record is not null").select("record.answer", "record.certainty")
    assert record._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1 and record.count() == 1


def test_reasons_of_a_document_meet_its_situation_only(spark):
    view = score_queries.view(spark, SF)
    plan = remedies.document_signals(view, score_queries.situations(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # verdicts and drivers stand in the document's row


def test_reports_are_made_in_the_document_s_own_row(spark):
    """Lines are grouped, orders and lines meet, and nothing else is shuffled; columns for the search of quotes hold no facts."""
    made = text_queries._reports(text_queries._wanted(spark, SF), text_queries._refused(spark, SF))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate [") == 1 and "Window" not in plan and plan.count("Union") == 1


def test_report_files_are_packed_and_the_only_copy(spark, monkeypatch):
    names, store, folder = [], files.stored, files.shared_folder
    monkeypatch.setattr(files, "stored", lambda rows, name: names.append(name) or store(rows, name))
    monkeypatch.setattr(files, "shared_folder", lambda s, name: names.append(folder(s, name)) or names[-1])
    few = text_queries._wanted(spark, SF).where("doc_id < 60")
    monkeypatch.setattr(text_queries, "_wanted", lambda s, d: few)
    found = {(r["kind"], r["problem"]): r["n"] for r in text_queries.read_reports(spark, SF).collect()}
    path = next(n for n in names if "report-files" in n)
    written = [p for p in pathlib.Path(path).iterdir() if p.name.startswith("part-")]
    assert "reports" not in names and sum(p.name.endswith(".gz") for p in written) >= len(written) - 3
    assert found[None, "malformed"] == found[None, "alien"] == found[None, "encoding"] == 1 and found["report", None] == few.count()


def test_differences_shuffle_keys_and_digests_of_all_rows_only(spark, monkeypatch):
    """Of 2,000 rows 3 differ: hardly any other is taken apart; a null key is no row's match."""
    row = lambda i, s, q: (i, "report", None, s, [("r", 1)], [(1, q)], (0,))
    old = nested(spark, [row(i, 1, "q") for i in range(2000)] + [row(None, 1, "q")])
    new = nested(spark, [row(i, 1 + (i == 7), "z" if i == 1500 else "q") for i in range(1, 2000)] + [row(None, 1, "q")])
    assert {r["doc_id"] for r in files.among(old, spark.createDataFrame([(5,), (None,)], "doc_id long"), "doc_id").collect()} == {5, None}
    found = {tuple(r) for r in files.diff_reports(old, new).collect()}
    assert {x for x in found if x[0] not in (0, None)} == {(7, "score", "1", "2"), (1500, "findings[0].quote", "q", "z")}
    assert (0, "score", "1", None) in found and (None, "score", "1", None) in found and (None, "score", None, "1") in found


def test_clean_texts_are_canonical_without_patterns(spark):
    """Trimming needs no pattern, and a clean text comes out of a branch that has none."""
    texts = ["clean text\n\nof two", " padded", "padded\u3000", "a\tb", "a  b", "co-\nop", "x \n y", "\n\n\n\n", "a\r\nb\rc", "in\u200bvisible", "", None, "UP-\nper", "\u00a0x\u2003"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumns({"c": tx.canonical(F.col("text")), "t": tx.trim_space(F.col("text"))})

    def plain(t):
        out = re.sub("[" + tx.INVISIBLE + "]", "", re.sub("\r\n?", "\n", t))
        out = re.sub(" *\n *", "\n", re.sub("[ \t]+", " ", re.sub("([a-z])-\n([a-z])", r"\1\2", out)))
        return re.sub(f"^[{tx.SPACE}]+|[{tx.SPACE}]+\\Z", "", re.sub("\n{3,}", "\n\n", out))

    for r in rows.collect():
        assert r["text"] is None and r["c"] is None or r["c"] == plain(r["text"]) and r["t"] == re.sub(f"^[{tx.SPACE}]+|[{tx.SPACE}]+\\Z", "", r["text"])
    plan = rows.select("t")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and rows.select("c")._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") == 1


def test_new_runs_make_no_report_again(spark, monkeypatch):
    """Ids are selected before reports are made: the second run makes those of its missing ids only, and none is stored twice."""
    made, names, whole, store = [], [], text_queries._reports, files.stored
    few = text_queries._wanted(spark, SF).where("doc_id < 60")
    monkeypatch.setattr(text_queries, "_wanted", lambda s, d: few)
    monkeypatch.setattr(text_queries, "_reports", lambda docs, refused: made.append({r["doc_id"] for r in docs.select("doc_id").collect()}) or whole(docs, refused))
    monkeypatch.setattr(files, "stored", lambda rows, name: names.append(name) or store(rows, name))
    text_queries.write_reports(spark, SF)
    assert not made[0] & made[1] and made[0] | made[1] == {r["doc_id"] for r in few.select("doc_id").collect()} and not names
