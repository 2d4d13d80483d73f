"""Alignment of the tokens of two vocabularies, A (byte-level) and B (word pieces).

A space and the text are encoded by both. Where tokens of both end at the same
byte, they cut the text into groups; the last A and the last B token of a group
are linked. The count of a pair of ids is the number of its links in the corpus.

* **Identity map.** An array, computed once, leads from each A id to the B id of
  the same bytes. Links of groups of one A and one B token that it knows are kept
  as counts of A ids, are added up in vectors as long as the vocabulary, and are
  looked up in such a vector.
* **Pair shuffle.** Only links of other groups are counted as pairs, by a shuffle.
  Two tokens of the same bytes that end together also begin together, so the two
  kinds of links share no pair.
* **Counts on links.** Of the shuffled pairs those with over a ``HEAVY``-th of all
  such links, fewer than ``HEAVY`` by arithmetic, go to every task with the
  vectors. Each of the others has at most that share of the links, so that the join
  which brings its count has no hot key.

A document's groups are made once; its links are stored as distinct ids or pairs
with numbers, and later steps read only these.

Edge cases: texts that are null, empty, or that either vocabulary does not give
back byte by byte have no tokens: zeros and empty groups. Texts of any length are
read whole; repeated rows count each time and repeat their results; an empty table
gives an empty result; a null ``doc_id`` stays null; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import byte_letters, stage

#: Pairs with more than this share of the shuffled links are sent to every task: fewer than so many, 16 bytes each.
HEAVY = 1 << 16
_BATCH = 1 << 20  # characters that are aligned together


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, byte_of = model["vocab"], {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in vocab.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if any(vocab[a + b] != 256 + rank for rank, (a, b) in enumerate(merges)):
            raise ValueError(f"{a_path}: ids do not follow the order of merges")
        self._a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for token, n in ranks.items():
            self.a_bytes[n] = token
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b = self._b
        self.b_bytes = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())
        ]
        # Of B ids with the same bytes the ordinary piece, which the encoder prefers to a single byte.
        same = {}
        for i in sorted(range(len(self.b_bytes)), key=b.is_byte, reverse=True):
            if not b.is_control(i) and not b.is_unknown(i):
                same[self.b_bytes[i]] = i
        self.identity = np.array([same.get(token, -1) for token in self.a_bytes], np.int64)
        self._a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self._b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        # Each id with what follows it: A ids within and at the end of a group's A side, then B ids likewise.
        self._written = [f"{i}{c}" for side, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for c in ends for i in range(len(side))]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each text; none if either does not give the text's bytes back."""
        a_ids, b_ids = [], []
        for text, b in zip(texts, self._b.encode(texts, num_threads=1)):
            whole = b" " + text.encode()
            a = self._a.encode_ordinary(" " + text) if text else []
            if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                a, b = [], []
            a_ids.append(a)
            b_ids.append(b)
        return a_ids, b_ids

    def align(self, texts: list[str]) -> pa.RecordBatch:
        a_ids, b_ids = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        # Both sides have the same bytes, text after text, so that ends are comparable over the whole batch.
        a_end, b_end = np.cumsum(self._a_length[a]), np.cumsum(self._b_length[b])
        marks = np.zeros((int(a_end[-1]) if len(a) else 0) + 1, np.uint8)
        marks[a_end] += 1
        marks[b_end] += 1
        a_last, b_last = np.flatnonzero(marks[a_end] == 2), np.flatnonzero(marks[b_end] == 2)  # of each group
        doc_of_a = np.repeat(np.arange(len(texts)), n_a)
        doc = doc_of_a[a_last]
        n_groups = np.bincount(doc, minlength=len(texts))
        # Links: by the identity map, or else as pairs.
        alone = (np.diff(a_last, prepend=-1) == 1) & (np.diff(b_last, prepend=-1) == 1)
        link_a, link_b = a[a_last], b[b_last]
        plain = alone & (self.identity[link_a] == link_b)
        columns = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)] + [pa.array(self._groups(a, b, a_last, b_last, n_a, n_b), pa.string())]
        for chosen, keys in ((plain, link_a), (~plain, link_a * len(self.b_bytes) + link_b)):
            columns += _numbers(doc[chosen], keys[chosen], len(texts))
        return pa.RecordBatch.from_arrays(columns, names=["n_a", "n_b", "n_groups", "groups", "same", "same_n", "pairs", "pairs_n"])

    def _groups(self, a, b, a_last, b_last, n_a, n_b) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        if not len(a):
            return [""] * len(n_a)
        group_of_a, group_of_b = (np.repeat(np.arange(len(last)), np.diff(last, prepend=-1)) for last in (a_last, b_last))
        b_before = np.concatenate([[0], b_last[:-1] + 1])
        written = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)) + b_before[group_of_a], np.arange(len(b)) + (a_last + 1)[group_of_b]
        written[at_a], written[at_b] = a, b + 2 * len(self.a_bytes)
        written[at_a[a_last]] += len(self.a_bytes)
        written[at_b[b_last]] += len(self.b_bytes)
        ends = np.cumsum(n_a + n_b).tolist()
        names = list(map(self._written.__getitem__, written.tolist()))
        return ["".join(names[start:end])[:-1] for start, end in zip([0, *ends], ends)]


def _numbers(doc: np.ndarray, keys: np.ndarray, n_docs: int) -> list[pa.Array]:
    """Distinct keys of each document, and how often each occurs, as two columns of lists."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
    number = np.diff(first, append=len(keys))
    offsets = pa.array(np.searchsorted(doc[first], np.arange(n_docs + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(keys[first], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(number, pa.int32()))]


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str, pattern: str) -> Vocabularies:
    return Vocabularies(a_path, b_path, pattern)


def groups(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups`` of each whole text, and its distinct links with their numbers.

    ``same`` holds A ids of links that the identity map knows, ``pairs`` the others
    as ``a * size_of_b + b``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(a_path, b_path, pattern)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                held, first, size = [], at, 0
                while at < batch.num_rows and (size < _BATCH or at == first):
                    held.append(texts[at].as_py() or "")
                    size += len(held[-1])
                    at += 1
                found = both.align(held)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *found.columns], names=["doc_id", *found.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, same array<long>, same_n array<int>, pairs array<long>, pairs_n array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _vector(found: DataFrame, key: str, value: str, size: int) -> np.ndarray:
    """A vector as long as a vocabulary from at most so many rows."""
    out = np.zeros(size, np.int64)
    rows = found.toPandas()
    out[rows[key].to_numpy(np.int64)] = rows[value].to_numpy(np.int64)
    return out


def identity_counts(stored: DataFrame, size: int) -> np.ndarray:
    """Links by the identity map, by A id. Every task adds up one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["a", "n"])

    found = stored.select("same", "same_n").mapInArrow(run, "a long, n long")
    return _vector(found.groupBy("a").agg(F.sum("n").alias("n")), "a", "n", size)


def pair_counts(stored: DataFrame) -> DataFrame:
    """``pair, n`` of the links that the identity map does not know."""
    each = stored.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.pairs_n").alias("n"))
    return each.groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``columns``.

    ``n_best`` links have a pair whose count is the highest of all pairs with its B
    id; ``count_sum`` adds up the counts of all links. ``columns`` are made from those
    of :func:`groups`; by default they are the groups themselves.
    """
    columns = {"groups": F.col("groups")} if columns is None else columns
    spark, both = docs.sparkSession, vocabularies(a_path, b_path, pattern)
    size_a, size_b = len(both.a_bytes), len(both.b_bytes)
    plain = ["doc_id", "n_a", "n_b", "n_groups"]
    found = groups(docs, a_path, b_path, pattern)
    stored = found.select(F.monotonically_increasing_id().alias("row"), *plain, "same", "same_n", "pairs", "pairs_n", *(c.alias(name) for name, c in columns.items()))
    stored = stage(stored, "alignment-links")
    same = identity_counts(stored, size_a)
    counts = stage(pair_counts(stored), "alignment-pairs")
    # The highest count of each B id, over both kinds of links.
    best = _vector(counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("n")), "b", "n", size_b)
    known = both.identity >= 0
    np.maximum.at(best, both.identity[known], same[known])
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") * HEAVY > total
    heavy = counts.where(is_heavy).orderBy("pair").toPandas()
    sent = spark.sparkContext.broadcast((same, both.identity, best, heavy["pair"].to_numpy(np.int64), heavy["n"].to_numpy(np.int64)))

    def sums(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, identity, best, heavy, heavy_n = sent.value
        for batch in batches:
            a, n = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())]).astype(np.int64)
            count_sum = sums(offsets, n * same[a])
            n_best = sums(offsets, n * (same[a] == best[identity[a]]))
            pair, n = batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy().astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())]).astype(np.int64)
            at = np.searchsorted(heavy, pair)
            there = np.zeros(len(pair), bool)
            inside = at < len(heavy)
            there[inside] = heavy[at[inside]] == pair[inside]
            count = np.zeros(len(pair), np.int64)
            count[there] = heavy_n[at[there]]
            highest = best[pair % size_b]
            count_sum += sums(offsets, n * count)
            n_best += sums(offsets, n * (there & (count == highest)))
            light = ~there
            lists = pa.array(sums(offsets, light).cumsum(), pa.int32())
            lists = pa.concat_arrays([pa.array([0], pa.int32()), lists])
            rest = pa.StructArray.from_arrays([pa.array(pair[light]), pa.array(n[light]), pa.array(highest[light])], names=["pair", "times", "highest"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count_sum), pa.array(n_best), pa.ListArray.from_arrays(lists, rest)], names=["row", "count_sum", "n_best", "rest"]
            )

    schema = "row long, count_sum long, n_best long, rest array<struct<pair: long, times: long, highest: long>>"
    mapped = stage(stored.select("row", "same", "same_n", "pairs", "pairs_n").mapInArrow(run, schema), "alignment-known")
    light = mapped.select("row", F.explode("rest").alias("e")).select("row", "e.*").join(counts.where(~is_heavy), "pair")
    light = light.select("row", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0).alias("n_best"))
    both_kinds = mapped.select("row", "count_sum", "n_best").unionByName(light).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = stored.select("row", *plain, F.col("n_groups").alias("n_links"), *columns).join(both_kinds, "row")
    return out.select(*plain, "n_links", "n_best", "count_sum", *columns)
