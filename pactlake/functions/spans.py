"""Regex matches with offsets. Offsets are code points, 0-based, half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = "array<struct<start:int,end:int,text:string>>"
_MARK = "\x01"  # stands around a match
_BLOCK = 64  # matches whose offsets are added up together


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """``struct<m, g>``: the matches of a pattern and the gaps around them, of one pass.

    Matches are set between marks and cut there; a text that has the mark itself is
    passed twice.
    """
    twice = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def dealt(parts: Column) -> Column:
        return F.struct(F.filter(parts, lambda x, i: i % 2 == 1).alias("m"), F.filter(parts, lambda x, i: i % 2 == 0).alias("g"))

    once = let(F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1), dealt)
    return F.when(F.contains(text, F.lit(_MARK)), twice).otherwise(once)


def match_spans(text: Column, pattern: str) -> Column:
    """All non-empty matches as ``array<struct<start, end, text>>``."""
    return let(matches(text, pattern), spans_of)


def spans_of(found: Column) -> Column:
    """Places of what :func:`matches` found.

    Offsets are running sums over gaps and matches. Sums of many are taken in blocks,
    and blocks are put together at the end, so that no array grows by copying.
    """

    def spans(found: Column) -> Column:
        pairs = F.zip_with(found["m"], F.slice(found["g"], F.lit(1), F.size(found["m"])), lambda m, g: F.struct(m.alias("text"), g.alias("gap")))

        def step(state: Column, pair: Column) -> Column:
            def placed(start: Column) -> Column:
                end = start + F.length(pair["text"])
                span = F.struct(start.alias("start"), end.alias("end"), pair["text"].alias("text"))
                return F.struct(end.alias("pos"), F.concat(state["out"], F.array(span)).alias("out"))

            return let(state["pos"] + F.length(pair["gap"]), placed)

        def block(state: Column, part: Column) -> Column:
            inner = F.aggregate(part, F.struct(state["pos"].alias("pos"), F.array().cast(_SPAN).alias("out")), step)
            return let(inner, lambda s: F.struct(s["pos"].alias("pos"), F.concat(state["blocks"], F.array(s["out"])).alias("blocks")))

        def all_of(pairs: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)))
            begin = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("blocks"))
            return F.aggregate(blocks, begin, block, lambda s: F.flatten(s["blocks"]))

        few = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out")), step, lambda s: s["out"])
        return F.when(F.size(found["m"]) == 0, F.array().cast(_SPAN)).when(F.size(found["m"]) <= _BLOCK, few).otherwise(let(pairs, all_of))

    return spans(found)


def piece(text: Column, start: Column, end: Column) -> Column:
    """The text of a span; starts before the text are moved to its beginning."""
    first = F.greatest(start, F.lit(0))
    return F.substring(text, first + 1, F.greatest(end - first, F.lit(0)))


def at(spans: Column, offset: Column) -> Column:
    """The first span of an array that contains an offset, or null."""
    return F.try_element_at(F.filter(spans, lambda s: (s["start"] <= offset) & (offset < s["end"])), F.lit(1))


def firsts(rows: Column, *key: str) -> Column:
    """Of an array of structs, sorted, the first of each key; ``key`` names its leading fields."""

    def changed(rows: Column) -> Column:
        def first(x: Column, i: Column) -> Column:
            before = F.try_element_at(rows, F.when(i > 0, i).otherwise(F.size(rows) + 1))
            same = F.lit(True)
            for name in key:
                same = same & x[name].eqNullSafe(before[name])
            return (i == 0) | ~same

        return F.filter(rows, first)

    return let(F.array_sort(rows), changed)
