"""Packing into optimal length buckets.

1. Lengths (words of the whole text) are counted per length over all documents.
   The histogram has at most one row per distinct length, so it is bounded by
   the longest document, not by the number of documents.
2. Dynamic programming over the histogram chooses up to ``buckets`` upper
   boundaries that minimise the total padding. The cost satisfies the
   quadrangle inequality, so each layer is solved by divide and conquer.
3. Inside each bucket, documents sorted by a hash of their id are cut into
   batches of ``max(1, token_budget // boundary)``. Positions come from
   per-cell row numbers plus the cells' offsets, so no bucket is one task.

Edge cases: null or empty texts have length 0, are padded to the boundary and
count as one token when batches are cut; a document longer than the budget is
a batch by itself; fewer distinct lengths than buckets give one bucket each
and no padding; an empty table gives an empty result; repeated rows are packed
one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import WORD, stage, text_or_empty


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries, ascending, of at most ``buckets`` buckets with least total padding.

    Of equally good choices the one with smaller earlier cuts is taken.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if n <= buckets:
        return x.tolist()
    number, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])

    def cost(first, last):  # padding of one bucket with lengths first..last
        return x[last] * (number[last + 1] - number[first]) - (total[last + 1] - total[first])

    best = cost(np.zeros(n, np.int64), np.arange(n))
    cuts = np.zeros((buckets, n), np.int64)
    for k in range(1, buckets):
        new = np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            low, high, from_, to = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            starts = np.arange(from_, min(mid, to) + 1)  # first length of the last bucket
            values = np.where(starts > 0, best[starts - 1], 0) + cost(starts, mid)
            at = int(np.argmin(values))
            new[mid], cuts[k, mid] = values[at], starts[at]
            todo += [(low, mid - 1, from_, int(starts[at])), (mid + 1, high, int(starts[at]), to)]
        best = new
    out, last = [], n - 1
    for k in range(buckets - 1, -1, -1):
        out.append(int(x[last]))
        if cuts[k, last] == 0:
            break
        last = int(cuts[k, last]) - 1
    return out[::-1]


def bucket_boundaries(measured: DataFrame, buckets: int) -> list[int]:
    rows = measured.groupBy("n_tokens").count().collect()  # one row per distinct length
    return optimal_boundaries(np.array([r["n_tokens"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64), buckets)


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 8192, cell_rows: int = 20_000) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, bucket_id, bucket_tokens, padding, batch_no, slot``."""
    measured = stage(docs.select("doc_id", word_count().alias("n_tokens")), "packing-lengths")
    bounds = bucket_boundaries(measured, buckets) or [0]
    chosen = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        chosen = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(chosen)
    upper = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket_id") + 1)
    cells = max(1, -(-measured.count() // cell_rows))
    placed = (
        measured.withColumn("bucket_id", chosen.cast("int")).withColumn("bucket_tokens", upper)
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(cells)))
    )
    sizes = placed.groupBy("bucket_id", "cell").count()
    before = Window.partitionBy("bucket_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_id", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    in_cell = Window.partitionBy("bucket_id", "cell").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens")
    ranked = placed.withColumn("at", F.row_number().over(in_cell) - 1).join(offsets, ["bucket_id", "cell"])
    position = F.col("offset") + F.col("at")
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.lit(1).cast("long"), F.col("bucket_tokens"))).cast("long"))
    return ranked.select(
        "doc_id", "n_tokens", "bucket_id", "bucket_tokens", (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
        F.floor(position / rows).cast("long").alias("batch_no"), F.pmod(position, rows).cast("int").alias("slot"),
    )
