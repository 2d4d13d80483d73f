"""Canonical text, match folding, numbers in words and rupee amounts."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlake.functions.spans import let

# --- fixed values -------------------------------------------------------------------------------
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: White space as the folding rules define it (the inside of a character class).
SPACE = "\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
FOLDED = {
    "'": "\u2018\u2019\u201a\u201b\u2032",
    '"': "\u201c\u201d\u201e\u2033",
    "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212",
    " ": "\u00a0\u2009\u202f",
}
WORD_VALUES = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {
    "hundred": 100, "thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "million": 1_000_000,
    "crore": 10_000_000, "crores": 10_000_000, "billion": 1_000_000_000,
}
IGNORED = ("and", "rupees", "rupee", "inr", "rs", "only")
NOISE = r"(?:[\s)\],:;–-]|\b(?:working|business|calendar|clear|consecutive|full|whole|complete|percent|cent|per|annum)\b)"
AMOUNT_NOISE = r"(?i)₹|\brs\.?\b|\binr\b|\brupees?\b|\bonly\b|/-"
MULTIPLIERS = ((r"(?i)\bcrores?\b|\bcr\b", 1e7), (r"(?i)\blakhs?\b|\blacs?\b", 1e5), (r"(?i)\bmillions?\b|\bmn\b", 1e6), (r"(?i)\bthousands?\b|\bk\b", 1e3))
MAX_CHARS = 400_000


_BLANKS = "".join(chr(c) for c in range(0x10000) if re.match(f"[{SPACE}]", chr(c)))
#: What a text has at least one of, or white space at an end, if canonicalisation changes it.
_DIRT = ("\r", "\t", "  ", " \n", "\n ", "\n\n\n", "-\n", *INVISIBLE)


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def canonical(text: Column) -> Column:
    """P1. A text that has nothing to change, as most have, costs no patterns."""
    dirty = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in _DIRT]) | (trim_space(text) != text)
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.translate(out, INVISIBLE, "")
    out = F.regexp_replace(out, "([a-z])-\n([a-z])", "$1$2")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, " *\n *", "\n")
    return F.when(dirty, trim_space(F.regexp_replace(out, "\n{3,}", "\n\n"))).otherwise(text)


def folded(text: Column) -> Column:
    """The form in which quotes and documents are compared."""
    # Sigma is lowered without regard to its place in a word, as every other letter is.
    source = "".join(FOLDED.values()) + "\u03a3" + INVISIBLE
    target = "".join(k * len(v) for k, v in FOLDED.items()) + "\u03c3"
    return F.lower(trim_space(F.regexp_replace(F.translate(text, source, target), f"[{SPACE}]+", " ")))


_KEPT, _DROPPED, _BLANK = range(3)


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point its lower-case folded form, and whether it is kept, dropped or white space."""
    odd = {0x130, 0x3A3, *range(0xD800, 0xE000)}  # lower case of two characters, by context, and none
    even = [c for c in range(0x110000) if c not in odd]
    form = np.arange(0x110000, dtype=np.uint32)
    form[even] = np.frombuffer("".join(map(chr, even)).lower().encode("utf-32-le"), np.uint32)
    form[0x3A3] = 0x3C3
    kind = np.zeros(0x110000, np.uint8)
    for plain, marks in FOLDED.items():
        form[[ord(c) for c in marks]] = ord(plain)
    kind[[c for c in range(0x10000) if re.match(f"[{SPACE}]", chr(c))]] = _BLANK
    kind[[ord(c) for c in FOLDED[" "]]] = _BLANK
    kind[[ord(c) for c in INVISIBLE]] = _DROPPED
    return form, kind


def fold_with_offsets(text: str) -> tuple[str, np.ndarray]:
    """The folded text and each of its characters' place in the text; a collapsed space has the next kept character's."""
    form, kind = _fold_tables()
    if "\u0130" in text:  # the one letter whose lower case has two characters: both have its place
        parts = [(c.lower() if c == "\u0130" else c) for c in text]
        low, offsets = fold_with_offsets("".join(parts))
        return low, np.repeat(np.arange(len(text), dtype=np.int32), list(map(len, parts)))[offsets]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kind[codes]
    places = np.flatnonzero(kinds != _DROPPED).astype(np.int32)
    solid = np.flatnonzero(kinds[places] == _KEPT)
    gap = np.diff(solid, prepend=solid[:1] - 1) > 1  # white space stands before
    at = np.arange(len(solid)) + np.cumsum(gap)
    out, offsets = np.full(len(solid) + int(gap.sum()), 0x20, np.uint32), np.empty(len(solid) + int(gap.sum()), np.int32)
    out[at], offsets[at] = form[codes[places[solid]]], places[solid]
    offsets[at[gap] - 1] = places[solid[gap]]
    return out.tobytes().decode("utf-32-le", "surrogatepass"), offsets


_ODD_BLANK = re.compile("[\x1c-\x1f]")  # white space to Python, not to the folding rules


def fold_plain(text: str) -> str:
    """P7 of a text, without places."""
    if text.isascii() and not _ODD_BLANK.search(text):
        return " ".join(text.split()).lower()
    return fold_with_offsets(text)[0]


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def number_words(phrase: Column) -> Column:
    """K7: the value of a number written in words; null if anything else is in it."""
    tokens = F.filter(F.split(F.lower(phrase), "[^a-z]+"), lambda t: t != "")

    def step(s: Column, token: Column) -> Column:
        value, scale = F.try_element_at(_map(WORD_VALUES), token), F.try_element_at(_map(SCALES), token)
        times = F.when(s["current"] == 0, 1.0).otherwise(s["current"])
        return F.struct(
            F.when(scale > 100, s["total"] + times * scale).otherwise(s["total"]).alias("total"),
            F.when(value.isNotNull(), s["current"] + value).when(scale == 100, times * 100).when(scale > 100, 0.0).otherwise(s["current"]).alias("current"),
            (s["saw"] | value.isNotNull() | scale.isNotNull()).alias("saw"),
            (s["bad"] | (value.isNull() & scale.isNull() & ~token.isin(*IGNORED))).alias("bad"),
        )

    begin = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("current"), F.lit(False).alias("saw"), F.lit(False).alias("bad"))
    return F.aggregate(tokens, begin, step, lambda s: F.when(s["saw"] & ~s["bad"], s["total"] + s["current"]))


_NUMBER_WORD = "(?:" + "|".join([*WORD_VALUES, *SCALES, *IGNORED]) + ")"
_TRAILING_WORDS = rf"(?i)(?<![A-Za-z])({_NUMBER_WORD}(?![A-Za-z])(?:{NOISE}*+(?<![A-Za-z]){_NUMBER_WORD}(?![A-Za-z]))*+){NOISE}*+$"


def trailing_words(window: Column) -> Column:
    """Number words that end a window, past noise: ``struct<value, start>`` or null."""

    def placed(m: Column) -> Column:
        found = lambda value: F.when((m["tail"] != "") & value.isNotNull(), F.struct(value.alias("value"), (m["length"] - F.length(m["tail"])).alias("start")))
        return let(number_words(m["words"]), found)

    def parts(tail: Column) -> Column:
        # The words stand at the tail's beginning, so the window is searched once.
        return let(F.struct(tail.alias("tail"), F.regexp_extract(tail, _TRAILING_WORDS, 1).alias("words"), F.length(window).alias("length")), placed)

    return let(F.regexp_extract(window, _TRAILING_WORDS, 0), lambda tail: F.when(tail != "", parts(tail)))


def trailing_figure(window: Column) -> Column:
    """Digits that end a window, past noise."""

    def placed(head: Column) -> Column:
        def figure(digits: Column) -> Column:
            value = F.regexp_replace(digits, ",", "").try_cast("double")
            return F.when(digits != "", F.struct(value.alias("value"), (F.length(head) - F.length(digits)).alias("start")))

        return let(F.regexp_extract(head, r"(\d[\d,]*(?:\.\d+)?)$", 1), figure)

    return let(F.regexp_replace(window, rf"(?i){NOISE}++$", ""), placed)


def trailing_value(window: Column) -> Column:
    """K8: words, digits, or both (the digits' value from where the words start)."""

    def of(w: Column) -> Column:
        def either(figure: Column) -> Column:
            before = F.regexp_replace(F.substring(w, F.lit(1), figure["start"]), r"[\s(]+$", "")
            both = F.struct(figure["value"].alias("value"), F.coalesce(trailing_words(before)["start"], figure["start"]).alias("start"))
            return F.when(figure.isNull(), trailing_words(w)).otherwise(both)

        return let(trailing_figure(w), either)

    return let(window, of)


def rupees(raw: Column) -> Column:
    """K9: a rupee amount's value, or null."""

    def value(cleaned: Column) -> Column:
        factor = F.lit(1.0)
        for pattern, times in reversed(MULTIPLIERS):
            factor = F.when(cleaned.rlike(pattern), times).otherwise(factor)
        number = F.regexp_replace(F.regexp_extract(cleaned, r"-?\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("double")
        return let(number, lambda n: F.when(n >= 0, n * factor))

    return let(F.trim(F.regexp_replace(raw, AMOUNT_NOISE, " ")), value)
