"""Quotes located in documents (G1-G12) and the facts they support."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.functions.spans import let
from pactlake.functions.text import fold_plain, fold_with_offsets, folded, trim_space
from pactlake.sources.files import stored

# --- fixed values -------------------------------------------------------------------------------
MIN_SIMILARITY, MIN_QUOTE, MARGIN = 0.82, 24, 0.05
REASONS = ("quote_empty", "quote_too_short", "not_found", "below_threshold", "ambiguous", "duplicate")

_BUNDLE = 256  # numbers of quotes that travel with a text together
_FEW = 8  # quotes that are looked for one by one in a text, before an automaton pays
_NEEDLES = 1024  # quotes without an inner word that meet a text together
_GRAMS = 1 << 20  # n-grams of quotes, 8 bytes each, up to which they are sent to every task


def _keyed_pairs(texts: list[str], owners: np.ndarray) -> np.ndarray:
    """A number for every character pair of every text: the pair's below 2^42, the owner's above it."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(list(map(len, texts)), dtype=np.int64)
    inner = np.ones(max(len(codes) - 1, 0), bool)
    inner[ends[(ends > 0) & (ends < len(codes))] - 1] = False  # the last character of a text and the first of the next
    return ((np.repeat(owners, list(map(len, texts)))[:-1] << 42) | (codes[:-1] << 21) | codes[1:])[inner]


def _shared_pairs(texts: list[str], quotes: list[list[str]]) -> list[list[int]]:
    """Of every text's quotes the character pairs that they share with it, each as often as the rarer side has it."""
    each = [q for these in quotes for q in these]
    of = np.repeat(np.arange(len(texts), dtype=np.int64), list(map(len, quotes)))
    known, times = np.unique(_keyed_pairs(texts, np.arange(len(texts), dtype=np.int64)), return_counts=True)
    wanted, need = np.unique(_keyed_pairs(each, np.arange(len(each), dtype=np.int64)), return_counts=True)
    quote, shared = wanted >> 42, np.zeros(len(each), np.int64)
    if len(known) and len(wanted):
        key = (of[quote] << 42) | (wanted & ((1 << 42) - 1))
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        shared = np.bincount(quote, np.where(known[at] == key, np.minimum(times[at], need), 0), len(each)).astype(np.int64)
    return [part.tolist() for part in np.split(shared, np.cumsum(list(map(len, quotes)))[:-1])]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shared(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    texts, quotes = [t or "" for t in texts], [[q or "" for q in these] for these in quotes]
    out, first, held = [], 0, 0
    for i, (text, these) in enumerate(zip(texts, quotes), 1):  # as many rows at once as have some 500,000 characters
        held += len(text) + sum(map(len, these))
        if held >= 500_000 or i == len(texts):
            out += _shared_pairs(texts[first:i], quotes[first:i])
            first, held = i, 0
    return pd.Series(out, dtype=object)


def bigram_dice(quotes: DataFrame, docs: DataFrame, key: str = "ord") -> DataFrame:
    """Multiset Dice over character pairs of each quote ``a`` (``doc_id, key, a``) and its document ``b`` (``doc_id, b``).

    A text meets all quotes of its document in one row and its pairs are counted
    there once, so that no pair is shuffled. Documents with more quotes than a
    bundle holds are a row for every bundle.
    """
    bundle = F.pmod(F.xxhash64(key), F.ceil(F.col("many") / _BUNDLE))
    sized = quotes.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    bundles = sized.groupBy("doc_id", bundle.alias("bundle")).agg(F.collect_list(F.struct(key, "a")).alias("quotes"))
    rows = bundles.join(docs.select("doc_id", "b"), "doc_id").withColumn("shared", _shared("b", F.transform("quotes", lambda q: q["a"])))
    a, n_b = F.col("q.a"), F.col("n_b")
    score = F.when((F.length(a) == n_b) & (F.md5(a) == F.col("digest")), 1.0).when((F.length(a) < 2) | (n_b < 2), 0.0).otherwise(2.0 * F.col("q.shared") / (F.length(a) + n_b - 2))
    each = F.arrays_zip(F.col("quotes")[key].alias(key), F.col("quotes")["a"].alias("a"), F.col("shared").alias("shared"))
    rows = rows.select("doc_id", F.length("b").alias("n_b"), F.md5("b").alias("digest"), F.explode(each).alias("q"))
    return rows.select("doc_id", F.col("q")[key].alias(key), score.alias("similarity"))


class _Document:
    """A folded document: the places of every character pair, sorted once for all of its quotes."""

    def __init__(self, text: str):
        self.text = text
        self._pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @staticmethod
    def pairs_of(text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return codes[:-1] << np.uint64(32) | codes[1:]

    def places(self, grams: np.ndarray) -> list[np.ndarray]:
        """Where each pair stands, in order."""
        if self._pairs is None:
            seen = self.pairs_of(self.text)
            order = np.argsort(seen, kind="stable")
            known, first = np.unique(seen[order], return_index=True)
            self._pairs = known, np.append(first, len(seen)), order
        known, first, order = self._pairs
        at = np.searchsorted(known, grams)
        there = at < len(known)
        there[there] = known[at[there]] == grams[there]
        return [order[first[i] : first[i + 1]] if ok else order[:0] for i, ok in zip(at.tolist(), there.tolist())]


def _first_places(text: str, quotes: list[str]) -> dict[str, int]:
    """The first place of every quote that stands in the text: one pass of an automaton of all of them."""
    if len(quotes) <= _FEW:
        places = {quote: text.find(quote) for quote in quotes}
        return {quote: at for quote, at in places.items() if at >= 0}
    machine = ahocorasick.Automaton()
    for quote in quotes:
        machine.add_word(quote, quote)
    machine.make_automaton()
    found: dict[str, int] = {}
    for end, quote in machine.iter(text):
        if quote not in found:
            found[quote] = end + 1 - len(quote)
            if len(found) == len(machine):
                break
    return found


class _Windows:
    """Dice scores of one quote against windows of a folded document.

    Windows are counted from running sums of each pair's places where these fit in
    a bounded table, else from the places themselves: memory grows with the document alone.
    """

    def __init__(self, document: _Document, quote: str, table: int = 1 << 20):
        self.n, self.w = len(document.text), len(quote)
        grams, self.need = np.unique(document.pairs_of(quote), return_counts=True)
        self.places = document.places(grams)
        self.sums = None
        if len(grams) * (self.n + 1) <= table:
            self.sums = np.zeros((len(grams), self.n + 1), np.int32)
            self.sums[np.repeat(np.arange(len(grams)), list(map(len, self.places))), np.concatenate(self.places) + 1] = 1
            np.cumsum(self.sums, axis=1, out=self.sums)

    def best(self, first: int, last: int, stride: int) -> tuple[int, float]:
        """The earliest best window among first, first + stride, ... up to last; (-1, 0) if none scores."""
        p = np.arange(first, last + 1, stride)
        if not len(p):
            return -1, 0.0
        stop = np.minimum(p + self.w, self.n)
        right = np.maximum(stop - p - 1, 0)
        if self.sums is not None:
            shared = np.minimum(self.sums[:, p + right] - self.sums[:, p], self.need[:, None]).sum(axis=0)
        else:
            shared = np.zeros(len(p), np.int64)
            for need, places in zip(self.need, self.places):
                if len(places):
                    shared += np.minimum(np.searchsorted(places, p + right) - np.searchsorted(places, p), need)
        score = np.where(stop - p < 2, 0.0, 2.0 * shared / (self.w - 1 + right))
        i = int(np.argmax(score))
        return (int(p[i]), float(score[i])) if score[i] > 0 else (-1, 0.0)


def _hopeless(text: str, quote: str, min_similarity: float) -> str | None:
    """Why no window of a text can match a quote, or None: a bound from what the whole text has of the quote's pairs."""
    w = len(quote)
    if len(text) - int(w * 0.8) <= 0:
        return "not_found"
    # Some coarse window holds each pair of the text, and none shares more of the quote's pairs than the whole text has.
    shared = sum(quote[i : i + 2] in text for i in range(w - 1))
    if shared == 0:
        return "not_found"
    if 2.0 * shared / (w - 1 + max(shared, int(w * 0.8) - 1)) < min_similarity - 1e-9:
        return "below_threshold"
    return None


def locate_fuzzy(document: str | _Document, quote: str, min_similarity: float = MIN_SIMILARITY, margin: float = MARGIN) -> tuple[str | None, int, float]:
    """G4, G5 over folded texts: (reason or None, place, similarity)."""
    document = document if isinstance(document, _Document) else _Document(document)
    w = len(quote)
    stride, limit = max(1, w // 8), len(document.text) - int(w * 0.8)
    reason = _hopeless(document.text, quote, min_similarity)
    if reason is not None:
        return reason, -1, 0.0
    windows = _Windows(document, quote)
    at, _ = windows.best(0, limit, stride)
    if at < 0:
        return "not_found", -1, 0.0
    at, score = windows.best(max(0, at - stride), min(limit, at + stride), 1)
    if score < min_similarity:
        return "below_threshold", at, score
    _, before = windows.best(0, min(limit, at - w), stride)
    _, after = windows.best(max(0, at + w), limit, stride)  # this grid starts anew
    if max(before, after) >= min_similarity and score - max(before, after) < margin:
        return "ambiguous", at, score
    return None, at, score


_PLACE = T.StructType([T.StructField(n, t) for n, t in (("reason", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("method", T.StringType()), ("similarity", T.DoubleType()))])


def _before(sizes: np.ndarray) -> np.ndarray:
    """The sum of all sizes before each."""
    return np.cumsum(sizes) - sizes


class _AllWindows:
    """Dice scores of many quotes (two characters or more) against every window of their own folded texts.

    A pair of the text counts in the windows that hold it, less those that hold as
    many of its like before it as the quote has: one interval of windows for each
    place, so that running sums of where intervals begin and end are the shared
    pairs of all windows. Time and memory grow with the texts.
    """

    def __init__(self, texts: list[str], quotes: list[str]):
        owners = np.arange(len(texts), dtype=np.int64)
        self.n, self.w = np.array(list(map(len, texts)), np.int64), np.array(list(map(len, quotes)), np.int64)
        wanted, need = np.unique(_keyed_pairs(quotes, owners), return_counts=True)
        seen = _keyed_pairs(texts, owners)
        at = np.minimum(np.searchsorted(wanted, seen), len(wanted) - 1)
        hit = np.flatnonzero(wanted[at] == seen)
        hit = hit[np.argsort(at[hit], kind="stable")]  # by quote and pair, then by place
        pair, owner = at[hit], seen[hit] >> 42
        place = hit - _before(np.maximum(self.n - 1, 0))[owner]
        times = np.bincount(pair, minlength=len(wanted))
        nth = np.arange(len(hit)) - need[pair]
        like = np.where(nth >= _before(times)[pair], place[np.maximum(nth, 0)], -1)
        self.first = _before(self.n + 1)
        begin = np.bincount(self.first[owner] + np.maximum(np.maximum(place - self.w[owner] + 2, like + 1), 0), minlength=int((self.n + 1).sum()))
        self.shared = np.cumsum(begin - np.bincount(self.first[owner] + place + 1, minlength=len(begin)))

    def best(self, first: np.ndarray, last: np.ndarray, stride: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each quote what :meth:`_Windows.best` finds."""
        place, top = np.full(len(self.n), -1), np.zeros(len(self.n))
        count = np.maximum((last - first) // stride + 1, 0)
        some = np.flatnonzero(count)
        if len(some):
            own = np.repeat(np.arange(len(count)), count)
            p = first[own] + (np.arange(len(own)) - np.repeat(_before(count), count)) * stride[own]
            width = np.minimum(self.w[own], self.n[own] - p)
            score = np.where(width < 2, 0.0, 2.0 * self.shared[self.first[own] + p] / (self.w[own] - 1 + np.maximum(width - 1, 0)))
            most = np.maximum.reduceat(score, _before(count)[some])
            equal = np.flatnonzero(score == np.repeat(most, count[some]))
            earliest = equal[np.searchsorted(own[equal], some)]
            place[some], top[some] = np.where(most > 0, p[earliest], -1), most
        return place, top


def locate_fuzzy_all(texts: list[str], quotes: list[str], min_similarity: float = MIN_SIMILARITY, margin: float = MARGIN) -> list[tuple[str | None, int, float]]:
    """What :func:`locate_fuzzy` says of each quote (two characters or more) and its text, all searched together."""
    out: list = [(_hopeless(text, quote, min_similarity), -1, 0.0) for text, quote in zip(texts, quotes)]
    rest = [i for i, found in enumerate(out) if found[0] is None]
    if not rest:
        return out
    g = _AllWindows([texts[i] for i in rest], [quotes[i] for i in rest])
    stride, zero = np.maximum(1, g.w // 8), np.zeros(len(rest), np.int64)
    limit = g.n - (g.w * 0.8).astype(np.int64)
    left = np.ones(len(rest), bool)
    until = lambda last: np.where(left, last, -1)
    coarse, _ = g.best(zero, until(limit), stride)
    lost = coarse < 0
    left = ~lost
    at, score = g.best(np.maximum(0, coarse - stride), until(np.minimum(limit, coarse + stride)), zero + 1)
    low = left & (score < min_similarity)
    left &= ~low
    _, before = g.best(zero, until(np.minimum(limit, at - g.w)), stride)
    _, after = g.best(np.maximum(0, at + g.w), until(limit), stride)  # this grid starts anew
    other = np.maximum(before, after)
    ambiguous = left & (other >= min_similarity) & (score - other < margin)
    reason = np.select([lost, low, ambiguous], ["not_found", "below_threshold", "ambiguous"], "")
    for i, r, a, s in zip(rest, reason.tolist(), at.tolist(), score.tolist()):
        out[i] = r or None, a, s
    return out


def _fuzzy_all(texts: list[str], quotes: list[str]) -> list[tuple[str | None, int, float]]:
    """:func:`locate_fuzzy_all`, as many at once as have some 500,000 characters."""
    out, first, held = [], 0, 0
    for i, (text, quote) in enumerate(zip(texts, quotes), 1):
        held += len(text) + len(quote)
        if held >= 500_000 or i == len(texts):
            out += locate_fuzzy_all(texts[first:i], quotes[first:i])
            first, held = i, 0
    return out


def _search_together(texts: list[str], quotes: list[list[str]]) -> list[list[tuple]]:
    """Outcomes of every text's quotes that are nowhere verbatim, in their order; a text is folded once, all fuzzy searches are made together."""
    lows = [fold_plain(text) for text in texts]
    needles = [[fold_plain(quote) for quote in these] for these in quotes]
    exact, far = [], []
    for i, (low, these) in enumerate(zip(lows, needles)):
        exact.append(_first_places(low, sorted({n for n in these if len(n) >= 2})))
        far += [(i, n) for n in dict.fromkeys(these) if len(n) >= 2 and n not in exact[-1]]
    fuzzy = dict(zip(far, _fuzzy_all([lows[i] for i, _ in far], [n for _, n in far])))
    out = []
    for i, (text, low) in enumerate(zip(texts, lows)):
        rows, offsets = [], None
        for needle in needles[i]:
            reason, at, method, score = "quote_too_short", -1, "normalised", 1.0
            if needle in exact[i]:
                reason, at = None, exact[i][needle]
            elif len(needle) >= 2:
                method = "fuzzy"
                reason, at, score = fuzzy[i, needle]
            if reason is not None:
                rows.append((reason, None, None, None, None))
                continue
            last = min(at + len(needle), len(low)) - 1
            if len(low) == len(text) and text.isascii():  # nothing was dropped: a space has the place of what follows it
                first, end = at + (low[at] == " "), last + (low[last] == " ") + 1
            else:
                offsets = fold_with_offsets(text)[1] if offsets is None else offsets
                first, end = int(offsets[at]), int(offsets[last]) + 1
            rows.append((None, first, end, method, score))
        out.append(rows)
    return out


def _search_all(text: str, quotes: list[str]) -> list[tuple]:
    """Outcomes of one text's quotes."""
    return _search_together([text], [quotes])[0]


@F.pandas_udf(T.ArrayType(_PLACE))
def _search(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    some = [i for i, (text, these) in enumerate(zip(texts, quotes)) if text is not None and len(these)]
    out: list = [[] for _ in texts]
    for i, rows in zip(some, _search_together([texts[i] for i in some], [list(quotes[i]) for i in some])):
        out[i] = [dict(zip(_PLACE.names, row)) for row in rows]
    return pd.Series(out, dtype=object)


def _carried(quotes: DataFrame) -> list[str]:
    return [c for c in quotes.columns if c not in ("doc_id", "ord", "quote", "text")]


def _asked(carried: list[str]) -> Column:
    own = F.struct(*carried) if carried else F.struct(F.lit(None).cast("string").alias("none"))
    return F.struct("ord", trim_space(F.coalesce("quote", F.lit(""))).alias("trimmed"), own.alias("own"))


def _bundled(quotes: DataFrame, docs: DataFrame, how: str = "left") -> DataFrame:
    """``doc_id, quotes, text``: one row, with one text, for all quotes of a document, an array of ``ord, trimmed, own``.

    ``own`` holds what else the quotes have. Documents with more quotes are a row
    for every 256 numbers of quotes.
    """
    q = quotes.select("doc_id", _asked(_carried(quotes)).alias("q"))
    bundles = q.groupBy("doc_id", F.floor(F.col("q.ord") / _BUNDLE).alias("bundle")).agg(F.collect_list("q").alias("quotes"))
    return bundles.join(docs.select("doc_id", "text"), "doc_id", how)


def locate(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """One outcome per quote: ``status, reason, start, end, method, similarity, matched_text``, beside what else ``quotes`` has.

    A text meets all quotes of its document in one row. Verbatim quotes are
    settled there; a text with others goes, once, to folding, an automaton of all
    of them and fuzzy search in an Arrow batch. A quote whose document is not
    there is not found.
    """
    return _outcomes(_bundled(quotes, docs), _carried(quotes))


def locate_beside(rows: DataFrame) -> DataFrame:
    """G6 of quotes that already stand beside their text (``doc_id, ord, quote, text``), each row its own bundle: nothing is joined."""
    carried = _carried(rows)
    return _outcomes(rows.select("doc_id", "text", F.array(_asked(carried)).alias("quotes")), carried)


def locate_nested(rows: DataFrame) -> DataFrame:
    """G6 of quotes nested beside their text: ``doc_id, text, findings``, an array of structs of ``ord, quote`` and what else they have."""
    asked, carried = _nested(rows)
    return _outcomes(rows.select("doc_id", "text", asked.alias("quotes")), carried)


def _nested(rows: DataFrame) -> tuple[Column, list[str]]:
    """Nested findings as bundled quotes, and what they carry."""
    carried = [c for c in rows.schema["findings"].dataType.elementType.names if c not in ("ord", "quote")]
    own = lambda f: F.struct(*[f[c].alias(c) for c in carried]) if carried else F.struct(F.lit(None).cast("string").alias("none"))
    return F.transform("findings", lambda f: F.struct(f["ord"].alias("ord"), trim_space(F.coalesce(f["quote"], F.lit(""))).alias("trimmed"), own(f).alias("own"))), carried


def locate_in_place(rows: DataFrame) -> DataFrame:
    """G6 in the document's own row: ``findings``, as :func:`locate_nested` takes them, become their outcomes; all other columns stay."""
    asked, carried = _nested(rows)
    return _searched(rows.withColumn("quotes", asked).drop("findings")).withColumn("findings", F.transform("looked", _outcome(carried))).drop("quotes", "looked", "needles", "searched")


def _outcomes(bundles: DataFrame, carried: list[str]) -> DataFrame:
    """Outcomes of bundled quotes (``doc_id, text, quotes``)."""
    return _searched(bundles).select("doc_id", F.explode(F.transform("looked", _outcome(carried))).alias("o")).select("doc_id", "o.*")


def _searched(bundles: DataFrame) -> DataFrame:
    """Bundled quotes after a first look, with what was searched for and what was found."""

    def first_look(x: Column) -> Column:
        early = F.when(x["trimmed"] == "", "quote_empty").when(F.length(x["trimmed"]) < MIN_QUOTE, "quote_too_short").when(F.col("text").isNull(), "not_found")
        return F.struct(x["ord"].alias("ord"), x["trimmed"].alias("trimmed"), x["own"].alias("own"), early.alias("early"), F.when(early.isNull(), F.instr(F.col("text"), x["trimmed"]) - 1).alias("at"))

    rows = bundles.withColumn("looked", F.transform("quotes", first_look)).drop("quotes")
    needles = F.array_distinct(F.transform(F.filter("looked", lambda x: x["at"] < 0), lambda x: x["trimmed"]))
    rows = rows.withColumn("needles", needles)
    return rows.withColumn("searched", _search(F.when(F.size("needles") > 0, F.col("text")), F.col("needles")))


def _outcome(carried: list[str]):
    """Of a quote that was looked for: ``ord``, what it carries, reason or place, status and the text there."""
    none = F.lit(None)

    def outcome(x: Column) -> Column:
        found = F.try_element_at("searched", F.array_position("needles", x["trimmed"]).cast("int"))
        exact = F.struct(none.cast("string").alias("reason"), x["at"].alias("start"), (x["at"] + F.length(x["trimmed"])).alias("end"), F.lit("exact").alias("method"), F.lit(1.0).alias("similarity"))
        refused = F.struct(x["early"].alias("reason"), *[none.cast(kind).alias(name) for name, kind in (("start", "int"), ("end", "int"), ("method", "string"), ("similarity", "double"))])
        place = F.when(x["at"] >= 0, exact).when(x["early"].isNotNull(), refused).otherwise(found)

        def whole(p: Column) -> Column:
            text = F.when(p["reason"].isNull(), F.substring("text", p["start"] + 1, p["end"] - p["start"]))
            status = F.when(p["reason"].isNull(), "grounded").otherwise("unverified")
            return F.struct(x["ord"].alias("ord"), *[x["own"][c].alias(c) for c in carried], *[p[c].alias(c) for c in _PLACE.names], status.alias("status"), text.alias("matched_text"))

        return let(place, whole)

    return outcome


def _first_in(quotes: DataFrame, docs: DataFrame, form) -> DataFrame:
    """``doc_id, ord, start`` of the quotes of 24 characters or more that stand in their text, both in ``form``."""
    rows = _bundled(quotes, docs, "inner").withColumn("formed", form(F.col("text")))
    start = lambda x: F.struct(x["ord"].alias("ord"), F.when(F.length(x["trimmed"]) >= MIN_QUOTE, F.instr(F.col("formed"), form(x["trimmed"])) - 1).alias("start"))
    found = F.filter(F.transform("quotes", start), lambda x: x["start"] >= 0)
    return rows.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def locate_exact(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """G1."""
    return _first_in(quotes, docs, lambda text: text)


def locate_normalised(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """The first place in folded text (folded offsets)."""
    return _first_in(quotes, docs, folded)


def dedup_findings(located: DataFrame) -> DataFrame:
    """Of grounded findings with the same place and category the first stays; the others are duplicates."""
    grounded = F.col("status") == "grounded"
    same = Window.partitionBy("doc_id", grounded, "start", "end", "category").orderBy("ord")
    again = grounded & (F.row_number().over(same) > 1)
    marked = located.withColumn("again", again)
    reason, status = F.when(F.col("again"), "duplicate").otherwise(F.col("reason")), F.when(F.col("again"), "unverified").otherwise(F.col("status"))
    return marked.withColumns({"reason": reason, "status": status}).drop("again")


def dedup_of(findings: Column) -> Column:
    """G7 of outcomes nested in their document's row."""
    grounded = lambda f: f["status"] == "grounded"
    earlier = lambda f, g: grounded(g) & (g["ord"] < f["ord"]) & (g["start"] == f["start"]) & (g["end"] == f["end"]) & g["category"].eqNullSafe(f["category"])

    def marked(f: Column) -> Column:
        again = grounded(f) & F.exists(findings, lambda g: earlier(f, g))
        return F.when(again, f.withField("reason", F.lit("duplicate")).withField("status", F.lit("unverified"))).otherwise(f)

    return F.transform(findings, marked)


def stats_of(findings: Column) -> Column:
    """G9 of outcomes nested in their document's row; null where there are none."""
    n = lambda test: F.size(F.filter(findings, test)).cast("long")
    of_method = lambda m: n(lambda f: (f["status"] == "grounded") & (f["method"] == m)).alias(m)
    of_reason = lambda r: n(lambda f: f["reason"] == r).alias(r)
    counts = F.struct(
        F.size(findings).cast("long").alias("total"), n(lambda f: f["status"] == "grounded").alias("grounded"), *map(of_method, ("exact", "normalised", "fuzzy")),
        n(lambda f: f["status"] != "grounded").alias("rejected"), *map(of_reason, REASONS),
    )
    return F.when(F.size(findings) > 0, counts)


def evidence_of(grounded: Column, name) -> Column:
    """F4 of grounded findings nested in their document's row: ``name, ord, start, end``, so that a name's greatest entry is its last place."""
    return F.transform(grounded, lambda f: F.struct(name(f).alias("name"), f["ord"].alias("ord"), f["start"].alias("start"), f["end"].alias("end")))


def verify_findings(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Every finding with its outcome; nothing is dropped."""
    return dedup_findings(locate(findings, docs))


def grounding_stats(verified: DataFrame) -> DataFrame:
    """G9."""
    return verified.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "grounded").alias("grounded"),
        *[F.count_if((F.col("status") == "grounded") & (F.col("method") == m)).alias(m) for m in ("exact", "normalised", "fuzzy")],
        F.count_if(F.col("status") != "grounded").alias("rejected"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS],
    )


def verify_answers(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` answers stand only if their quote is in the document."""
    rows = locate(answers.select("doc_id", "ord", "quote", "found", "prose"), docs)
    verdict = F.when(~F.col("found"), "not_in_document").when(F.col("status") != "grounded", "unverified").otherwise("grounded")
    return rows.select("doc_id", "ord", verdict.alias("verdict"), F.when(verdict == "grounded", F.col("prose")).alias("prose"), F.when(verdict == "grounded", F.col("matched_text")).alias("located"))


def corpus_quote_search(quotes: DataFrame, docs: DataFrame, words: int = 5) -> DataFrame:
    """Quotes without a document against a whole corpus: word n-grams block, folded text decides.

    One scan of the corpus makes n-grams of hashed words and keeps those that some
    quote has (the quotes' n-grams go to every task if they are few by count);
    only these postings are stored. A quote then looks up its rarest n-gram, so a
    common passage costs one posting list, and candidates are checked in the
    document's own task. Both ends of a quote may cut words, so only its inner
    words make n-grams, shorter ones if it has fewer than ``words`` of them. Quotes
    without an inner word meet every document, in blocks.
    """

    def grams_of(hashes: Column, n: int, first: Column | int, last: Column) -> Column:
        """Hashes of the runs of ``n`` words that begin at ``first`` to ``last``."""
        return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), lambda i: F.xxhash64(F.lit(n), *[F.element_at(hashes, i + k) for k in range(n)])))

    def hashed(rows: DataFrame, key: str, text: str) -> DataFrame:
        split = rows.select(key, folded(F.col(text)).alias("needle")).withColumn("w", F.split("needle", " "))
        return split.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))

    own = hashed(quotes, "quote_id", "quote").withColumn("inner", F.size("w") - 2)
    bare = own.where("inner < 1 and needle <> ''").select("quote_id", "needle")
    own = own.where("inner >= 1").withColumn("n", F.least(F.lit(words), F.col("inner")))
    of_quote = F.coalesce(*[F.when(F.col("n") == k, grams_of(F.col("h"), k, 2, F.size("h") - k)) for k in range(1, words + 1)])
    own = stored(own.select("quote_id", "needle", "n", F.explode(F.array_distinct(of_quote)).alias("gram")), "quote-grams")
    lengths = sorted(r["n"] for r in own.select("n").distinct().collect())  # at most ``words`` of them
    none = F.array().cast("array<bigint>")
    of_text = F.concat(none, *[F.coalesce(grams_of(F.col("h"), k, 1, F.size("h") - k + 1), none) for k in lengths])
    wanted = own.select("gram").distinct()
    if wanted.count() <= _GRAMS:
        wanted = F.broadcast(wanted)
    each = hashed(docs, "doc_id", "text").select("doc_id", F.explode(F.array_distinct(of_text)).alias("gram"))
    posting = stored(each.join(wanted, "gram", "left_semi"), "quote-postings")
    frequent = posting.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = own.join(frequent, "gram").groupBy("quote_id").agg(F.min_by(F.struct("gram", "needle"), F.struct("df", "gram")).alias("r"))
    candidates = rarest.select("quote_id", "r.gram", "r.needle").join(posting, "gram").select("doc_id", "quote_id", "needle")
    texts = docs.select("doc_id", folded(F.col("text")).alias("folded"))
    hits = texts.join(candidates, "doc_id").where(F.contains("folded", F.col("needle"))).select("doc_id", "quote_id", (F.instr(F.col("folded"), F.col("needle")) - 1).alias("folded_start"))
    if bare.isEmpty():
        return hits
    blocks = bare.groupBy(F.pmod(F.xxhash64("quote_id"), F.ceil(F.lit(bare.count()) / _NEEDLES)).alias("block")).agg(F.collect_list(F.struct("quote_id", "needle")).alias("these"))
    met = texts.crossJoin(blocks.select("these")).select("doc_id", "folded", F.explode(F.filter("these", lambda q: F.contains(F.col("folded"), q["needle"]))).alias("q"))
    return hits.unionByName(met.select("doc_id", "q.quote_id", (F.instr(F.col("folded"), F.col("q.needle")) - 1).alias("folded_start")))


def highlight_spans(verified: DataFrame, docs: DataFrame) -> DataFrame:
    """A greedy choice of non-overlapping findings cuts each text into plain and marked pieces; a text without any is one plain piece."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "ord")))
    per = verified.where("status = 'grounded'").groupBy("doc_id").agg(spans.alias("spans"))
    kind = "array<struct<start:int,end:int,ord:int>>"

    def step(s: Column, x: Column) -> Column:
        fits = x["start"] >= s["cursor"]
        return F.struct(F.when(fits, x["end"]).otherwise(s["cursor"]).alias("cursor"), F.when(fits, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    chosen = F.aggregate("spans", F.struct(F.lit(0).alias("cursor"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])
    rows = docs.select("doc_id", F.length("text").alias("n")).join(per, "doc_id", "left").withColumn("c", F.coalesce(chosen, F.array().cast(kind)))
    previous = lambda i: F.coalesce(F.try_element_at("c", i)["end"], F.lit(0))
    plain = F.transform("c", lambda x, i: F.struct(F.when(i > 0, previous(F.greatest(i, F.lit(1)))).otherwise(0).alias("start"), x["start"].alias("end"), F.lit(None).cast("int").alias("ord")))
    last = F.coalesce(F.try_element_at("c", F.lit(-1))["end"], F.lit(0))
    pieces = F.concat(plain, "c", F.array(F.struct(last.alias("start"), F.col("n").alias("end"), F.lit(None).cast("int").alias("ord"))))
    return rows.select("doc_id", F.explode(F.filter(pieces, lambda p: p["end"] > p["start"])).alias("p")).select("doc_id", "p.*")


# --- facts ---------------------------------------------------------------------------------------
def ground_citations(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """``citations(doc_id, ord, name, quote)`` with their places; those not found are demoted."""
    return locate(citations.select("doc_id", "ord", "name", "quote"), docs).withColumn("demoted", F.col("status") != "grounded")


def fact_view_numbers(view: DataFrame, cited: DataFrame, fields: list[str]) -> DataFrame:
    """a field with any failed citation is unknown; uncited numbers stay."""
    failed = cited.where("demoted").groupBy("doc_id").agg(F.collect_set("name").alias("failed"))  # at most one entry per field
    rows = view.join(failed, "doc_id", "left")
    return rows.select("doc_id", *[F.when(~F.coalesce(F.array_contains("failed", f), F.lit(False)), F.col(f)).alias(f) for f in fields])


PRESENCES = ("unclear", "absent", "present")


def fact_view_constructs(asserted: DataFrame, docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``asserted(doc_id, ord, construct, presence, quote, located)``; the last assertion wins, none means unclear.

    The last assertion is the largest number made of its place and presence, so
    that sums of one size are held for each construct, and no strings. Other
    presences than those of the contract are unclear.
    """
    blank = F.col("quote").isNull() | (trim_space(F.col("quote")) == "")
    presence = F.when((F.col("presence") == "present") & ~blank & ~F.coalesce("located", F.lit(False)), "unclear").otherwise(F.col("presence"))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, PRESENCES)), presence) - 1, F.lit(-1))
    rows = asserted.select("doc_id", "construct", (F.col("ord").cast("long") * 4 + F.greatest(code, F.lit(0))).alias("last"))
    last = rows.groupBy("doc_id").agg(*[F.max(F.when(F.col("construct") == c, F.col("last"))).alias(c) for c in vocabulary])
    said = lambda c: F.coalesce(F.try_element_at(F.array(*map(F.lit, PRESENCES)), (F.pmod(c, F.lit(4)) + 1).cast("int")), F.lit(PRESENCES[0]))
    return docs.select("doc_id").join(last, "doc_id", "left").select("doc_id", *[said(F.col(c)).alias(c) for c in vocabulary])


def evidence_index(cited: DataFrame) -> DataFrame:
    """the last grounded place per name."""
    return cited.where("not demoted").groupBy("doc_id", "name").agg(F.max_by(F.struct("start", "end"), "ord").alias("at")).select("doc_id", "name", "at.start", "at.end")


def demotion_audit(cited: DataFrame) -> DataFrame:
    """F5."""
    return cited.where("demoted").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("demoted"), F.count(F.lit(1)).alias("n"))
