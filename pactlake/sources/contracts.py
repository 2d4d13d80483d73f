"""Contracts of model outputs: nested declarations compiled to violation Columns.

A declaration says what a record holds. :func:`violations` turns it into one
Column over a VARIANT: an array of ``path:rule`` for everything that a record
breaks, at whatever depth. :func:`ddl` gives the typed schema of the same
declaration. Both are plain expressions, so a batch of records is checked in the
scan's own tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions.spans import let
from pactlake.plans.rules import BOUNDS, CATEGORIES, CONSTRUCTS, DOCUMENT_TYPES
from pactlake.sources.files import stored


@dataclass(frozen=True)
class Text:
    least: int = 0
    most: int | None = None
    pattern: str | None = None
    choices: tuple[str, ...] | None = None
    nullable: bool = False


@dataclass(frozen=True)
class Number:
    integer: bool = False
    low: float | None = None
    high: float | None = None
    nullable: bool = False


@dataclass(frozen=True)
class Flag:
    nullable: bool = False


@dataclass(frozen=True)
class Rows:
    item: "Record"
    most: int
    nullable: bool = False


@dataclass(frozen=True)
class Record:
    fields: dict
    nullable: bool = False


# --- fixed values: the four kinds of model outputs -------------------------------------------------
_PARTY = Text(choices=("you", "counterparty", "both", "unclear"))
FACTS = Record(
    {"documentType": Text(choices=tuple(DOCUMENT_TYPES)), "governingLawState": Text(most=60, nullable=True), "jurisdictionCity": Text(most=60, nullable=True)}
    | {name: Number(integer, low, high, nullable=True) for name, (integer, low, high) in BOUNDS.items()}
    | {
        "constructs": Rows(Record({"construct": Text(choices=tuple(CONSTRUCTS)), "presence": Text(choices=("present", "absent", "unclear")), "exactQuote": Text(most=600, nullable=True)}), 24),
        "citations": Rows(Record({"field": Text(choices=tuple(BOUNDS)), "exactQuote": Text(12, 400)}), 40),
    }
)
FINDINGS = Record({"findings": Rows(Record({
    "id": Text(pattern=r"^f\d{1,3}$"), "category": Text(choices=tuple(CATEGORIES)), "exactQuote": Text(24, 600), "clauseLabel": Text(most=40, nullable=True),
    "plainSummary": Text(10, 400), "obligationOn": _PARTY, "benefits": _PARTY, "isUnusual": Flag(),
}), 60)})
CLASSIFICATION = Record({
    "isLegalDocument": Flag(), "documentType": Text(choices=tuple(DOCUMENT_TYPES)), "language": Text(choices=("en", "hi")),
    "notLegalReason": Text(most=200, nullable=True), "confidence": Text(choices=("high", "medium", "low")),
})
ANSWER = Record({"foundInDocument": Flag(), "answer": Text(1, 1200), "exactQuote": Text(most=600, nullable=True), "certainty": Text(choices=("stated", "implied", "not_addressed"))})
KINDS = {"facts": FACTS, "findings": FINDINGS, "classification": CLASSIFICATION, "answer": ANSWER}


def ddl(declared) -> str:
    """The type of a declaration."""
    if isinstance(declared, Record):
        return "struct<" + ", ".join(f"{name}: {ddl(d)}" for name, d in declared.fields.items()) + ">"
    if isinstance(declared, Rows):
        return f"array<{ddl(declared.item)}>"
    return {Text: "string", Number: "double", Flag: "boolean"}[type(declared)]


def _found(path: Column, *rules: tuple[Column, str]) -> Column:
    """Of rules, each a condition and its name, those whose condition holds."""
    return F.array_compact(F.array(*[F.when(broken, F.concat(path, F.lit(f":{name}"))) for broken, name in rules]))


def _rules(declared, value: Column) -> list[tuple[Column, str]]:
    """The rules of a typed value, each a condition that breaks it and its name."""
    rules = []
    if isinstance(declared, Text):
        if declared.least:
            rules.append((F.length(value) < declared.least, "too_short"))
        if declared.most is not None:
            rules.append((F.length(value) > declared.most, "too_long"))
        if declared.pattern:
            rules.append((~value.rlike(declared.pattern), "pattern"))
        if declared.choices:
            rules.append((~value.isin(*declared.choices), "choice"))
    if isinstance(declared, Number):
        if declared.integer:
            rules.append((value != F.floor(value), "integer"))
        if declared.low is not None:
            rules.append((value < declared.low, "too_small"))
        if declared.high is not None:
            rules.append((value > declared.high, "too_large"))
    return rules


def _checked(declared, value: Column, path: Column) -> Column:
    """The violations of a value of the declared kind."""
    if isinstance(declared, (Text, Number)):
        return _found(path, *_rules(declared, F.try_variant_get(value, "$", ddl(declared))))
    if isinstance(declared, Rows):
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: _compiled(declared.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        size = F.size(F.try_variant_get(value, "$", "array<variant>"))
        return F.concat(_found(path, (size > declared.most, "too_many")), F.flatten(each))
    if isinstance(declared, Record):
        inner = [_compiled(d, F.try_variant_get(value, f"$.{name}", "variant"), F.concat(path, F.lit(f".{name}"))) for name, d in declared.fields.items()]
        return F.concat(*inner)
    return F.array().cast("array<string>")


_TYPES = {Text: "STRING", Number: "BIGINT|DOUBLE|FLOAT|DECIMAL.*", Flag: "BOOLEAN", Rows: "ARRAY.*", Record: "OBJECT.*"}


def _compiled(declared, value: Column, path: Column) -> Column:
    """Missing, null where it must not be, of another type, or what the declared kind finds."""

    def judged(v: Column) -> Column:
        empty = F.array().cast("array<string>")
        kind = F.schema_of_variant(v)
        wrong = empty if declared.nullable else _found(path, (F.lit(True), "null"))
        return (
            F.when(v.isNull(), _found(path, (F.lit(True), "missing"))).when(F.is_variant_null(v), wrong)
            .when(~kind.rlike(f"^({_TYPES[type(declared)]})$"), _found(path, (F.lit(True), "type"))).otherwise(_checked(declared, v, path))
        )

    return let(value, judged)


def violations(kind: str, json: Column) -> Column:
    """``path:rule`` of everything in which a JSON string breaks the contract of its kind; ``:malformed`` if it is none."""
    return let(F.try_parse_json(json), lambda v: F.when(v.isNull(), F.array(F.lit(":malformed"))).otherwise(_compiled(KINDS[kind], v, F.lit("$"))))


# --- records whose fields are all there, of their types --------------------------------------------
def _shape(declared) -> str:
    """A pattern for the type of a VARIANT (its fields are sorted) that has every field of a declaration, and no other."""
    if isinstance(declared, Record):
        out = "OBJECT<" + ", ".join(f"{name}: {_shape(declared.fields[name])}" for name in sorted(declared.fields)) + ">"
    elif isinstance(declared, Rows):
        out = f"ARRAY<(?:VOID|{_shape(declared.item)})>"
    else:
        out = {Text: "STRING", Number: r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\([^)]*\))", Flag: "BOOLEAN"}[type(declared)]
    return f"(?:VOID|{out})" if declared.nullable else out


def _held(declared, inside: bool = False) -> str:
    """:func:`ddl`, but inside of arrays, where types are merged, nullable fields stay VARIANT: a missing one differs from null."""
    if inside and declared.nullable:
        return "variant"
    if isinstance(declared, Record):
        return "struct<" + ", ".join(f"{name}: {_held(d, inside)}" for name, d in declared.fields.items()) + ">"
    if isinstance(declared, Rows):
        return f"array<{_held(declared.item, True)}>"
    return ddl(declared)


def _there(declared, value: Column, inside: bool = False) -> Column:
    """Whether nothing is missing or null in the arrays of a value, as far as its type cannot tell."""
    if isinstance(declared, Record):
        return reduce(Column.__and__, [_there(d, value[name], inside) for name, d in declared.fields.items()], value.isNotNull() if inside else F.lit(True))
    if isinstance(declared, Rows) and not (inside and declared.nullable):
        each = F.forall(value, lambda x: _there(declared.item, x, True))
        return value.isNotNull() & each if inside else value.isNull() | each
    return value.isNotNull() if inside else F.lit(True)


def _broken(declared, value: Column, path: Column, inside: bool = False) -> list[Column]:
    """The violations of a typed value, as strings, null where there is none, and arrays of such."""
    if inside and declared.nullable:
        value = F.try_variant_get(value, "$", ddl(declared))
        inside = False
    if isinstance(declared, Record):
        return [c for name, d in declared.fields.items() for c in _broken(d, value[name], F.concat(path, F.lit(f".{name}")), inside)]
    if isinstance(declared, Rows):
        def item(x: Column, i: Column) -> Column:
            return F.array(*_broken(declared.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), True))

        return [F.when(F.size(value) > declared.most, F.concat(path, F.lit(":too_many"))), F.flatten(F.transform(value, item))]
    return [F.when(broken, F.concat(path, F.lit(f":{name}"))) for broken, name in _rules(declared, value)]


def _sound(lines: DataFrame) -> DataFrame:
    """``lines`` with a column per kind: the typed record, null if it is of another kind or does not have all fields in their types."""
    rows = lines.withColumn("v", F.when(F.col("kind").isin(*KINDS), F.try_parse_json("json"))).withColumn("shape", F.schema_of_variant("v"))
    fits = lambda kind: (F.col("kind") == kind) & F.col("shape").rlike(f"^{_shape(KINDS[kind])}$")
    return rows.withColumns({f"as_{kind}": F.when(fits(kind), F.from_json("json", _held(KINDS[kind]), {"mode": "PERMISSIVE"})) for kind in KINDS}).drop("v", "shape")


def read_model_outputs(lines: DataFrame, kind: str) -> DataFrame:
    """``doc_id`` and the typed ``record`` of each JSON line of a kind; null where it does not parse."""
    parsed = F.from_json("json", ddl(KINDS[kind]) if kind in KINDS else kind, {"mode": "PERMISSIVE"})
    record = F.when(F.try_parse_json("json").isNotNull(), parsed)
    # The generator keeps the record whole: else every use of one of its fields would parse the line again.
    return lines.where(F.col("kind") == kind).select("doc_id", "json", F.explode(F.array(record)).alias("record"))


def validate_model_outputs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, kind, json`` without violations, and the quarantined with theirs.

    Records of a kind that no contract knows are quarantined as ``:kind``. Records
    are checked once and stored with what was found. Those that have every field in
    its type are checked as typed values; only the others are looked at field by
    field for what is missing, null or of another type.
    """
    found = F.array(F.lit(":kind"))
    for kind, declared in KINDS.items():
        typed = F.col(f"as_{kind}")
        said = F.array_remove(F.split(F.concat_ws("\n", *_broken(declared, typed, F.lit("$"))), "\n"), "")
        one = F.when(typed.isNotNull() & _there(declared, typed), said).otherwise(violations(kind, F.col("json")))
        found = F.when(F.col("kind") == kind, one).otherwise(found)
    checked = stored(_sound(lines.select("doc_id", "kind", "json")).select("doc_id", "kind", "json", found.alias("violations")), "checked-outputs")
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
