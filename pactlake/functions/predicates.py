"""Rule predicates compiled to Columns. NULL stands for "unknown", so SQL's logic is the rules' logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__}


def compile_predicate(predicate: tuple) -> Column:
    """A nullable boolean over a wide fact view (numbers as DOUBLE, constructs as BOOLEAN)."""
    op, *rest = predicate
    if op in _COMPARE:
        return _COMPARE[op](F.col(rest[0]), F.lit(float(rest[1])))
    if op == "ratio_gte":
        n, d, value = F.col(rest[0]), F.col(rest[1]), float(rest[2])
        return F.when(d == 0, F.when(n > 0, F.lit(True))).otherwise(n / d >= value)
    if op == "multiple_gte":
        field, of, divide, value = rest
        return F.try_divide(F.col(field), F.col(of) / float(divide)) >= float(value)
    if op == "construct_present":
        return F.col(rest[0])
    if op == "construct_absent":
        return ~F.col(rest[0])
    if op == "field_missing":
        return F.col(rest[0]).isNull()
    if op == "all_of":
        return reduce(Column.__and__, map(compile_predicate, rest))
    if op == "any_of":
        return reduce(Column.__or__, map(compile_predicate, rest))
    if op == "not":
        return ~compile_predicate(rest[0])
    raise ValueError(f"unknown predicate {op!r}")


def predicate_sql(predicate: tuple) -> str:
    """The same predicate as ANSI SQL text, with DOUBLE and BOOLEAN columns."""
    op, *rest = predicate
    if op in _COMPARE:
        return f"({rest[0]} {dict(gte='>=', gt='>', lte='<=', lt='<')[op]} {float(rest[1])})"
    if op == "ratio_gte":
        n, d, value = rest
        return f"(CASE WHEN {d} = 0 THEN CASE WHEN {n} > 0 THEN TRUE END ELSE {n} / {d} >= CAST({float(value)} AS DOUBLE) END)"
    if op == "multiple_gte":
        field, of, divide, value = rest
        return f"(CASE WHEN {of} = 0 THEN NULL ELSE {field} / ({of} / CAST({float(divide)} AS DOUBLE)) >= CAST({float(value)} AS DOUBLE) END)"
    if op == "construct_present":
        return rest[0]
    if op == "construct_absent":
        return f"(NOT {rest[0]})"
    if op == "field_missing":
        return f"({rest[0]} IS NULL)"
    if op == "not":
        return f"(NOT {predicate_sql(rest[0])})"
    return "(" + {"all_of": " AND ", "any_of": " OR "}[op].join(map(predicate_sql, rest)) + ")"
