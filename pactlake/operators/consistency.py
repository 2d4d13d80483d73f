"""Contradictions inside a contract.

``docs`` is ``doc_id, text``. What a detector finds is an array of the document's
own row, made by a Column function (``..._of``); nothing is joined or shuffled, and
:func:`detect_inconsistencies` reads every text once for all five kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions.spans import at, firsts, let, match_spans, matches, piece, spans_of
from pactlake.functions.text import number_words, rupees, trailing_figure, trailing_value, trailing_words
from pactlake.operators.canonical import segments_of

# --- fixed values: patterns and windows ----------------------------------------------------------
_CLAUSE = "sub-?clauses?|clauses?|sections?|articles?|paragraphs?|paras?"
_SCHEDULE = "schedules?|annexures?|annexes?|appendices|appendix|exhibits?"
_LABEL = r"\d+(?:\.\d+)*|[A-Za-z]{1,3}"
REFERENCE = rf"(?i)\b({_CLAUSE}|{_SCHEDULE})\s+((?:{_LABEL})(?:\s*(?:,|and|&|to|through)\s*(?:{_LABEL}))*)"
SCHEDULE_HEADING = r"""(?im)^[ \t]*(?:schedule|annexure|annex|appendix|exhibit)\s*[-–—:]?\s*["'‘“]?([A-Za-z0-9]{1,3})\b"""
STATUTE = r"^\s*(?:of|under|read with)\s+(?:the\s+)?[^.\n]{0,70}?\b(?:Act|Code|Rules|Regulations|Constitution|Ordinance)\b"
QUOTED = r'["“‘]([A-Z][A-Za-z0-9&.\-/ ]{1,58}?)["”’]'
DEFINES = r"(?i)^[\s,]*(?:shall\s+|will\s+)?(?:means?\b|shall\s+have\s+the\s+meaning|has\s+the\s+meaning|refers?\s+to\b|is\s+defined\s+as\b|denotes?\b)"
NAMES = r"(?i)(?:referred\s+to\s+as|called|known\s+as|termed|the\s+term|the\s+expression)\s+(?:the\s+)?$"
BRACKETS = r"\(([^()\n]{1,40})\)"
RESIDUE = r"(?i)₹|\brs\.?|\binr\b|\brupees?\b|\bonly\b|\blakhs?\b|\blacs?\b|\bcrores?\b|\bthousand\b|\bmillion\b|per\s*cent|percent|/-|%|[\d,.\s-]"
DURATION = r"(?i)\b(days?|weeks?|months?|years?)\b"
MONEY = r"(?i)(?:₹\s*|\b(?:Rs\.?\s*|INR\s+|Rupees\s+))[\d,]+(?:\.\d+)?(?:\s*(?:lakhs?|crores?|thousand))?"
RATE = r"(?i)\d+(?:\.\d+)?\s*(?:%|per\s*cent|percent)"
CONCEPTS = [  # id, pattern, severity, in the order that breaks ties
    ("notice", r"(?i)\bnotice\b", "high"), ("lock_in", r"(?i)\block[\s-]?in\b", "high"), ("deposit", r"(?i)\b(?:security\s+)?deposit\b", "high"),
    ("rent", r"(?i)\brent(?:al)?\b", "high"), ("interest", r"(?i)\binterest\b", "medium"), ("probation", r"(?i)\bprobation(?:ary)?\b", "medium"),
    ("non_compete", r"(?i)\bnon[\s-]?compet\w*\b", "medium"), ("cure", r"(?i)\b(?:cure|rectif\w+|remedy)\b", "medium"),
]
KINDS = ("dangling_cross_reference", "undefined_term", "unused_definition", "figure_word_mismatch", "conflicting_quantity")
MONTH_DAYS, YEAR_DAYS, CONCEPT_WINDOW, TERM_CHARS = 30, 365, 90, 60


_REFERENCE = "struct<kind:string,keyword:string,label:string,start:int,end:int>"
ANY_CONCEPT = r"(?i)\b(?:" + "|".join(pattern.removeprefix(r"(?i)\b") for _, pattern, _ in CONCEPTS) + ")"  # the edge of a word is looked at once


def _rows(docs: DataFrame, found: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def references_of(text: Column) -> Column:
    """K1 as an array."""
    none = F.array().cast(f"array<{_REFERENCE}>")

    def labels(m: Column, gap: Column, i: Column) -> Column:
        def each(p: Column) -> Column:
            kind = F.when(p["keyword"].rlike("^(?:schedule|annex|append|exhibit)"), "schedule").otherwise("clause")
            first = m["end"] - F.length(p["list"])
            tokens = F.filter(match_spans(p["list"], _LABEL), lambda t: t["text"].rlike(r"^\d|^[A-Z]+$"))
            return F.transform(
                tokens,
                lambda t: F.struct(kind.alias("kind"), p["keyword"].alias("keyword"), t["text"].alias("label"), (first + t["start"]).alias("start"), (first + t["end"]).alias("end")),
            )

        before = F.rtrim(gap, F.lit(" \t"))  # since the match before, so a text is looked at once
        heading = ((before == "") & (i == 0)) | F.endswith(before, F.lit("\n"))
        statute = piece(text, m["end"], m["end"] + 90).rlike(STATUTE)
        parts = F.struct(F.lower(F.regexp_extract(m["text"], REFERENCE, 1)).alias("keyword"), F.regexp_extract(m["text"], REFERENCE, 2).alias("list"))
        return F.when(heading | statute, none).otherwise(let(parts, each))

    def each_with_gap(found: Column) -> Column:
        paired = F.zip_with(spans_of(found), F.slice(found["g"], F.lit(1), F.size(found["m"])), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
        return F.when(F.size(found["m"]) == 0, none).otherwise(F.flatten(F.transform(paired, lambda x, i: labels(x["m"], x["gap"], i))))

    return let(matches(text, REFERENCE), each_with_gap)


def cross_references(docs: DataFrame) -> DataFrame:
    """K1: labels that the text refers to, one row each."""
    return _rows(docs, references_of(F.col("text")))


def labels_of(text: Column, segments: Column | None = None) -> Column:
    """K2 as an array; ``segments`` are those of the text, where they are known."""
    pair = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    clauses = F.filter(F.transform(segments_of(text) if segments is None else segments, lambda s: pair("clause", F.regexp_replace(s["label"], r"\.$", ""))), lambda x: x["label"].rlike(r"^\d"))
    schedules = F.transform(F.regexp_extract_all(text, F.lit(SCHEDULE_HEADING), F.lit(1)), lambda x: pair("schedule", F.upper(x)))
    return F.array_distinct(F.concat(clauses, schedules))


def known_labels(docs: DataFrame) -> DataFrame:
    """K2: ``doc_id, kind, label`` of numbered clauses and of schedule headings."""
    return _rows(docs, labels_of(F.col("text")))


def dangling_of(text: Column, segments: Column | None = None) -> Column:
    """K3 as an array."""

    def with_ancestors(label: Column) -> Column:
        parts = F.split(label, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("clause:"), F.array_join(F.slice(parts, F.lit(1), n), ".")))

    def open_(found: Column) -> Column:
        known = found["known"]
        kinds = F.array_distinct(F.transform(known, lambda k: k["kind"]))
        keys = F.flatten(F.transform(known, lambda k: F.when(k["kind"] == "clause", with_ancestors(k["label"])).otherwise(F.array(F.concat(F.lit("schedule:"), k["label"])))))
        key = lambda r: F.concat(r["kind"], F.lit(":"), F.when(r["kind"] == "schedule", F.upper(r["label"])).otherwise(r["label"]))
        held = F.struct(kinds.alias("kinds"), F.array_distinct(keys).alias("keys"))
        return let(held, lambda h: F.filter(found["refs"], lambda r: F.array_contains(h["kinds"], F.lit("clause")) & F.array_contains(h["kinds"], r["kind"]) & ~F.array_contains(h["keys"], key(r))))

    return let(F.struct(references_of(text).alias("refs"), labels_of(text, segments).alias("known")), open_)


def dangling_references(docs: DataFrame) -> DataFrame:
    """K3: references to what the document does not have; silent where it has no labels of that kind."""
    return _rows(docs, dangling_of(F.col("text")))


def terms_of(text: Column) -> Column:
    """K4 as an array."""

    def term(m: Column) -> Column:
        after, before = piece(text, m["end"], m["end"] + 48), piece(text, m["start"] - 80, m["start"])
        defines = after.rlike(DEFINES) | before.rlike(NAMES) | before.rlike(r"\([^)]*$")
        return F.struct(F.trim(F.regexp_extract(m["text"], QUOTED, 1)).alias("term"), m["start"].alias("start"), m["end"].alias("end"), defines.alias("is_definition"))

    return F.filter(F.transform(match_spans(text, QUOTED), term), lambda t: (F.length(t["term"]) >= 3) & (F.length(t["term"]) <= TERM_CHARS))


def quoted_terms(docs: DataFrame) -> DataFrame:
    """K4."""
    return _rows(docs, terms_of(F.col("text")))


def undefined_of(terms: Column) -> Column:
    """K5 as an array, of K4's."""
    defined = F.transform(F.filter(terms, lambda t: t["is_definition"]), lambda t: t["term"])
    used = firsts(F.filter(terms, lambda t: ~t["is_definition"]), "term")
    return let(defined, lambda d: F.filter(used, lambda t: ~F.array_contains(d, t["term"])))


def undefined_terms(docs: DataFrame) -> DataFrame:
    """K5: one row per term, at its first use."""
    return _rows(docs, let(terms_of(F.col("text")), undefined_of)).drop("is_definition")


def unused_of(terms: Column, text: Column) -> Column:
    """K6 as an array, of K4's."""

    def unused(t: Column) -> Column:
        # All occurrences are in the definition's line. Neither a term nor what must stand around it reaches past a line.
        pattern = F.concat(F.lit(r"(?<![A-Za-z])\Q"), t["term"], F.lit(r"\E(?![A-Za-z])"))
        line = F.element_at(F.split(text, "\n"), F.size(F.split(piece(text, F.lit(0), t["start"]), "\n")))
        return F.regexp_count(text, pattern) == F.regexp_count(line, pattern)

    return F.filter(firsts(F.filter(terms, lambda t: t["is_definition"]), "term"), unused)


def unused_definitions(docs: DataFrame) -> DataFrame:
    """K6: defined terms that occur nowhere outside the line of their definition."""
    text = F.col("text")
    return _rows(docs, let(terms_of(text), lambda terms: unused_of(terms, text))).drop("is_definition")


def mismatches_of(text: Column) -> Column:
    """K10 as an array."""

    def mismatch(m: Column) -> Column:
        from_ = F.greatest(F.lit(0), m["start"] - 70)

        def compared(p: Column) -> Column:
            inner, before = p["inner"], p["before"]
            figure = F.when(F.trim(F.regexp_replace(inner, RESIDUE, "")) == "", rupees(inner))
            by_digits = lambda own, other: F.when(own != other["value"], _struct(from_ + other["start"], m["end"], other["value"], own))
            by_words = lambda own, other: F.when(own != other["value"], _struct(from_ + other["start"], m["end"], own, other["value"]))
            digits = let(F.struct(figure.alias("own"), trailing_words(before).alias("other")), lambda x: by_digits(x["own"], x["other"]))
            words = let(F.struct(number_words(inner).alias("own"), trailing_figure(before).alias("other")), lambda x: by_words(x["own"], x["other"]))
            return F.when(inner.rlike(r"\d"), digits).otherwise(words)

        return let(F.struct(F.regexp_extract(m["text"], BRACKETS, 1).alias("inner"), piece(text, from_, m["start"]).alias("before")), compared)

    return F.array_compact(F.transform(match_spans(text, BRACKETS), mismatch))


def _struct(start: Column, end: Column, words: Column, figure: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), words.alias("words"), figure.alias("figure"))


def figure_word_mismatch(docs: DataFrame) -> DataFrame:
    """Quantities stated twice, in words and in figures, that differ."""
    return _rows(docs, mismatches_of(F.col("text")))


def _place_of(match: Column) -> Column:
    """The number of the concept that a match of ``ANY_CONCEPT`` is."""
    place = F.lit(len(CONCEPTS))
    for i, (_, pattern, _) in reversed(list(enumerate(CONCEPTS))):
        place = F.when(match.rlike(pattern), i).otherwise(place)
    return place


def _nearest(concepts: Column, start: Column, end: Column) -> Column:
    """The least ``distance, place`` of concepts (``start, end, place``) to a span; earlier concepts win ties."""
    distance = lambda m: F.when(m["end"] <= start, start - m["end"]).otherwise(F.greatest(F.lit(0), m["start"] - end))
    return F.array_min(F.transform(concepts, lambda m: F.struct(distance(m).alias("distance"), m["place"].alias("place"))))


def concepts_of(text: Column) -> Column:
    return F.transform(match_spans(text, ANY_CONCEPT), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _place_of(m["text"]).alias("place")))


def concept_near(text: Column, start: Column, end: Column, concepts: Column | None = None) -> Column:
    """The closest concept within the window of a span, or null.

    The window is cut out of the text, so that a word cut at its edge may read as
    a concept. ``concepts``, those of the whole text, settle all spans that have
    one well inside.
    """
    first = F.greatest(F.lit(0), start - CONCEPT_WINDOW)
    name = lambda best: F.try_element_at(F.array(*[F.lit(c) for c, _, _ in CONCEPTS]), best["place"] + 1)
    cut = name(_nearest(concepts_of(piece(text, first, end + CONCEPT_WINDOW)), start - first, end - first))
    if concepts is None:
        return cut
    return let(_nearest(concepts, start, end), lambda best: F.when(best["distance"] <= CONCEPT_WINDOW // 2, name(best)).otherwise(cut))


def nearest_concept(spans: DataFrame) -> DataFrame:
    """Spans (``text, start, end``) with their concept; spans without one go."""
    named = spans.withColumn("concept", concept_near(F.col("text"), F.col("start"), F.col("end")))
    return named.where("concept is not null")


def quantities_of(text: Column) -> Column:
    """K11 as an array."""
    unit = lambda m: F.lower(m["text"])
    days = lambda m: F.when(unit(m).startswith("week"), 7).when(unit(m).startswith("month"), MONTH_DAYS).when(unit(m).startswith("year"), YEAR_DAYS).otherwise(1)

    def stated(family: str, value: Column, start: Column, end: Column) -> Column:
        found = F.struct(F.lit(family).alias("family"), value.cast("double").alias("value"), start.alias("start"), end.alias("end"))
        return F.when(value.isNotNull(), found)

    def duration(m: Column) -> Column:
        from_ = F.greatest(F.lit(0), m["start"] - 48)
        return let(trailing_value(piece(text, from_, m["start"])), lambda v: stated("duration", v["value"] * days(m), from_ + v["start"], m["end"]))

    def amounts(pattern: str, family: str) -> Column:
        return F.transform(match_spans(text, pattern), lambda m: let(rupees(m["text"]), lambda v: stated(family, v, m["start"], m["end"])))

    found = F.array_compact(F.concat(F.transform(match_spans(text, DURATION), duration), amounts(MONEY, "money"), amounts(RATE, "rate")))
    fields = ("family", "value", "start", "end")

    def named(concepts: Column) -> Column:
        return F.transform(found, lambda q: F.struct(concept_near(text, q["start"], q["end"], concepts).alias("concept"), *[q[f].alias(f) for f in fields]))

    return F.filter(let(concepts_of(text), named), lambda q: q["concept"].isNotNull())


def extract_quantities(docs: DataFrame) -> DataFrame:
    """Durations in days, money and rates, each with its nearest concept."""
    return _rows(docs, quantities_of(F.col("text")))


def conflicts_of(text: Column, segments: Column | None = None) -> Column:
    """K13 as an array."""

    def conflicts(held: Column) -> Column:
        keyed = lambda q: F.struct(*[q[c].alias(c) for c in ("concept", "family", "start", "end", "value")])
        clause = lambda q: at(held["segments"], q["start"])["segment_id"]  # looked up only where values differ

        def against(rows: Column) -> Column:
            def others(bases: Column) -> Column:
                def row(q: Column) -> Column:
                    base = F.try_element_at(F.filter(bases, lambda b: (b["concept"] == q["concept"]) & (b["family"] == q["family"])), F.lit(1))
                    differs = lambda b: F.when(
                        (q["value"] != b["value"]) & (clause(q) != clause(b)),
                        F.struct(
                            q["concept"].alias("concept"), q["family"].alias("family"), q["value"].alias("value"), q["start"].alias("start"), q["end"].alias("end"),
                            b["value"].alias("first_value"), b["start"].alias("first_start"),
                        ),
                    )
                    return let(base, differs)

                return firsts(F.array_compact(F.transform(rows, row)), "concept", "family", "value")

            return let(firsts(rows, "concept", "family"), others)  # a concept's first quantity of each family

        return let(F.transform(held["quantities"], keyed), against)

    return let(F.struct(quantities_of(text).alias("quantities"), (segments_of(text) if segments is None else segments).alias("segments")), conflicts)


def conflicting_quantities(docs: DataFrame) -> DataFrame:
    """Other values than the first of a concept and family, in another clause; each value once."""
    return _rows(docs, conflicts_of(F.col("text")))


def defects_of(text: Column) -> dict[str, Column]:
    """Per kind an array of ``start, end, kind, severity``."""
    severity = F.create_map(*[F.lit(x) for c, _, s in CONCEPTS for x in (c, s)])
    terms = F.col("terms")

    def marked(rows: Column, kind: str, how_bad) -> Column:
        return F.transform(rows, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(kind).alias("kind"), how_bad(r).alias("severity")))

    fixed = lambda s: lambda _: F.lit(s)
    found = (
        (dangling_of(text, F.col("segments")), fixed("high")), (undefined_of(terms), fixed("medium")), (unused_of(terms, text), fixed("low")),
        (mismatches_of(text), fixed("high")), (conflicts_of(text, F.col("segments")), lambda r: F.element_at(severity, r["concept"])),
    )
    return {kind: marked(rows, kind, how_bad) for kind, (rows, how_bad) in zip(KINDS, found, strict=True)}


def with_defects(docs: DataFrame) -> DataFrame:
    """Documents with their ``terms``, their ``segments`` and an array per kind, all else as it was."""
    text = F.col("text")
    return docs.withColumns({"terms": terms_of(text), "segments": segments_of(text)}).withColumns(defects_of(text))


def in_order() -> Column:
    """K14 as an array, of what :func:`with_defects` found."""
    return F.array_sort(F.concat(*KINDS))


def detect_inconsistencies(docs: DataFrame) -> DataFrame:
    """All of them, in order of place and kind."""
    found = with_defects(docs.select("doc_id", "text")).select("doc_id", F.posexplode(in_order()).alias("pos", "x"))
    return found.select("doc_id", "x.start", "x.end", "x.kind", "x.severity", (F.col("pos") + 1).alias("place"))


def count_by_kind(docs: DataFrame) -> DataFrame:
    """Every document with its counts, zeros included."""
    return with_defects(docs.select("doc_id", "text")).select("doc_id", *[F.coalesce(F.size(k), F.lit(0)).cast("long").alias(k) for k in KINDS])
