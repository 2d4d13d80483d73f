"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words whose smallest period is ``q``, at least
``max(6, 4 q)`` words long, that no neighbouring word extends with that period.

* Periods up to 4 are found by direct scans: words equal to the one ``q`` places on,
  over the whole sequence.
* Scale ``s`` finds the periods over ``2**s`` up to ``2**(s + 1)``. Blocks of
  ``2**(s + 1)`` words are hashed by doubling, and a place is a minimizer if its
  block has the least hash of some window of ``2**s`` places. In a run of such a
  period ``q`` blocks are no shorter than ``q``, so that equal blocks are ``q``, ``2 q``,
  ... apart and no others; two windows ``q`` apart fit into four periods and have
  minimizers ``q`` apart. So every run has two minimizers of equal hash next to
  each other at distance ``q``. Such pairs are seeds.
* A seed's lag is extended word by word in both directions, which makes the run
  exact whatever the hashes are. Seeds inside a stretch that is known for their
  lag are passed over. A lag whose proper divisor is a period of the stretch as
  well is not the smallest and is dropped.

Documents are joined to sequences of about 65,536 words, with a word that occurs
once between them; each scale keeps the documents long enough for it. So a
sequence costs about ``n log n`` numpy operations per scale, whatever repeats in it.

Edge cases: null or empty texts have no words and no runs; texts of any length
are read whole; repeated rows repeat their results; an empty table gives an
empty result; a null ``doc_id`` stays null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import SPACE

_DIRECT = 4  # periods found by direct scans; a power of two
_BATCH_WORDS = 1 << 16
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # the public SplitMix64 factors


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _A
    values = (values ^ (values >> np.uint64(27))) * _B
    return values ^ (values >> np.uint64(31))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every window of ``width`` (a power of two) values."""
    while width > 1:
        width //= 2
        values = best(values[:-width], values[width:]) if len(values) > width else values[:0]
    return values


def _extent(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch ``[start, end)`` around ``at`` in which words ``lag`` apart are equal."""
    n = len(words)
    end, size = at, 64
    while end + lag < n:
        stop = min(n - lag, end + size)
        apart = np.flatnonzero(words[end:stop] != words[end + lag : stop + lag])
        if len(apart):
            end += int(apart[0])
            break
        end, size = stop, 2 * size
    start, size = at, 64
    while start > 0:
        stop = max(0, start - size)
        apart = np.flatnonzero(words[stop:start] != words[stop + lag : start + lag])
        if len(apart):
            start = stop + int(apart[-1]) + 1
            break
        start, size = stop, 2 * size
    return start, end + lag


def _smallest(words: np.ndarray, start: int, end: int, lag: int) -> bool:
    """Whether no proper divisor of ``lag`` is a period of the stretch."""
    rest, prime = lag, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = lag // prime
            if np.array_equal(words[start : end - part], words[start + part : end]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _direct(words: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """Every long stretch of a short period."""
    least = max(6, 4 * lag) - lag
    if len(words) <= lag:
        return
    same = np.concatenate([[0], (words[:-lag] == words[lag:]).view(np.int8), [0]])
    edges = np.diff(same)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for start, end in zip(starts[ends - starts >= least].tolist(), ends[ends - starts >= least].tolist()):
        yield start, end + lag


def _seeds(words: np.ndarray, hashes: np.ndarray, scale: int) -> np.ndarray:
    """``(lag, place)`` of neighbouring equal minimizers, sorted. ``hashes`` are those of blocks of ``2**(scale + 1)``."""
    window = 1 << scale
    least = _sliding(hashes, window, np.minimum)
    if not len(least):
        return np.zeros((0, 2), np.int64)
    # A place is a minimizer if the greatest of its windows' minima is its own hash.
    top = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    places = np.flatnonzero(hashes == _sliding(top, window, np.maximum))
    found = hashes[places]
    order = np.argsort(found, kind="stable")  # by hash, then place
    places, found = places[order], found[order]
    lag = places[1:] - places[:-1]
    fits = (found[1:] == found[:-1]) & (lag > window) & (lag <= 2 * window)
    pairs = np.stack([lag[fits], places[:-1][fits]], axis=1)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def runs_of(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of all runs of each document, a document being an array of word numbers of 0 or more."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    long_enough = [i for i, d in enumerate(docs) if len(d) >= 6]
    # Each document with a word of its own after it: negative numbers.
    parts = [np.concatenate([docs[i].astype(np.int64), [-1 - k]]) for k, i in enumerate(long_enough)]
    if not parts:
        return out
    words = np.concatenate(parts)
    offsets = np.cumsum([0, *map(len, parts)])

    def add(start: int, end: int, lag: int) -> None:
        k = int(np.searchsorted(offsets, start, "right")) - 1
        if _smallest(words, start, end, lag):
            out[long_enough[k]].append((start - int(offsets[k]), end - start, lag))

    for lag in range(1, _DIRECT + 1):
        for start, end in _direct(words, lag):
            add(start, end, lag)
    scale = _DIRECT.bit_length() - 1
    hashes, reach = _mixed(words.view(np.uint64) * _A + _B), 1
    kept = np.array([len(p) for p in parts])  # lengths with the separator
    place = np.arange(len(words))  # of the kept words in the whole
    while True:
        # Documents that are too short for the next scale's least period go.
        stays = kept > 4 * ((1 << scale) + 1)
        if not stays.any():
            break
        if not stays.all():
            mask = np.repeat(stays, kept)
            # Blocks that reach into the next document hold the separator between, which occurs once.
            hashes, place, kept = hashes[mask[: len(hashes)]], place[mask], kept[stays]
        while reach < 2 << scale:
            if len(hashes) <= reach:
                hashes = hashes[:0]
                break
            hashes = _mixed(hashes[:-reach] * _A + hashes[reach:] * _B + np.uint64(reach))
            reach *= 2
        known_lag, known_end = 0, 0
        for lag, at in _seeds(words, hashes, scale).tolist():
            at = int(place[at])
            if lag == known_lag and at + lag < known_end:
                continue
            start, end = _extent(words, at, lag)
            known_lag, known_end = lag, end
            if end - start >= 4 * lag:
                add(start, end, lag)
        scale += 1
    for found in out:
        found[:] = sorted(set(found))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words outside runs and those of each run's first period, joined by spaces."""
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(stays).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text.

    ``runs`` holds ``start`` (number of the first word, from 0), ``length`` and
    ``period`` of every run, by start, then period. ``collapsed`` is the text
    with each run cut to its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                split, first, size = [], at, 0
                numbers: dict[bytes, int] = {}
                docs_: list[np.ndarray] = []
                while at < batch.num_rows and (size < _BATCH_WORDS or at == first):
                    words = (texts[at].as_py() or "").encode("utf-8", "surrogatepass").split()
                    split.append(words)
                    docs_.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
                    size += len(words)
                    at += 1
                found = runs_of(docs_)
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in each] for each in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, at - first), pa.array(map(len, split), pa.int64()), pa.array(runs, kind), pa.array(map(_collapsed, split, found), pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which a tenth of the texts repeat a passage to their end.

    With ``h`` the CRC-32 of the id in decimal and ``g = h // 10``: where ``h % 10``
    is 0, each of the ``n`` words from number ``a = g % n`` on becomes word ``a + (i - a) % p``
    of the text, ``p = 1 + (n - a) // (3 + g % 8)``. Texts with a null id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.split(F.regexp_replace("text", f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+")
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    # The passage, then as many copies of it as reach the end, cut there.
    head, passage = F.slice("w", 1, F.col("a")), F.slice("w", F.col("a") + 1, F.col("p"))
    copies = F.flatten(F.array_repeat(passage, F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.slice(F.concat(head, copies), F.lit(1), n), " ")
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chosen = F.coalesce((h % 10 == 0) & has_words, F.lit(False))
    found = docs.select("doc_id", "text", F.when(chosen, words).alias("w"), g.alias("g"))
    found = found.withColumn("a", a).withColumn("p", p)
    return found.select("doc_id", F.when(F.col("w").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def described(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`periodic_runs`: the run with the greatest length (ties: start, period), all runs, what is left."""

    def order(x: Column, y: Column) -> Column:
        return F.when(x["length"] > y["length"], -1).when(x["length"] < y["length"], 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(F.signum(x["period"] - y["period"]).cast("int"))

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = F.when(F.size("runs") > 0, F.element_at(F.array_sort("runs", order), 1))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
