"""Exact top-k by inner product over a bit-sliced index.

The index packs vectors, in the order in which tasks read them, into blocks of
``block_rows``. A block stores every component's bits vertically: one bitmap
per bit, two's complement, least significant first. A query's score for all
rows of a block is a sum of bitmaps: each set digit of a query component (in
signed-digit form) contributes the component's slices at a shifted weight, and
carry-save adders reduce all contributions of a weight, three bitmaps to two,
until a bit-sliced score remains. The ``k`` largest are selected from the most
significant slice down; rows tied at the boundary are resolved by identifier,
and the scores of selected rows are recomputed as plain integer products.

Every index block is written once and shuffled once (a few times if there are
fewer blocks than tasks to fill); blocks of compact query vectors are dealt to
all of them and stream past the block at hand in its task. Quantised components
are whole numbers held as doubles, hence exact at any size: a block has as many
slices as its largest value needs, and scores as many as their bound needs.

Edge cases: vectors that are null, or have null or non-finite components, or
another length than ``dims``, take no part, nor do rows with a null id; a query
never returns rows of its own id; rows that repeat an id are ranked one by one,
as candidates and as queries; a query with fewer than ``k`` candidates returns
all; ranks are exact at any magnitude, but a score beyond 64 bits is returned as
the nearest long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import stage

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LARGEST = float(np.finfo(np.float64).max)
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 1024, dims: int | None = None) -> DataFrame:
    """``vec_id, q``: each component as floor(scale * component), a whole number as a double, of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    keep = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False))
    if dims is not None:
        keep &= F.size(x) == dims
    def whole(v: Column) -> Column:
        y = v.cast("double") * F.lit(float(scale))
        # A double of 2**53 or more is a whole number; past the largest double the value stays there.
        y = F.when(F.abs(y) < F.lit(float(1 << 53)), F.floor(y).cast("double")).otherwise(y)
        return F.least(F.greatest(y, F.lit(-_LARGEST)), F.lit(_LARGEST))

    q = F.transform(x, whole)
    return vectors.where(keep).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def _bits(values: np.ndarray) -> int:
    """Bits of two's complement that hold all the whole numbers of an array of doubles."""
    return max(1, int(np.abs(values).max(initial=0)).bit_length()) + 1


def _integers(values: np.ndarray, bits: int) -> np.ndarray:
    """Doubles as integers: 64-bit ones where they fit, else Python's."""
    if bits <= 63:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, dims) integers as bitmaps (dims, bits, words)."""
    rows, dims = values.shape
    width = -(-rows // 64)
    padded = np.zeros((width * 64, dims), values.dtype)
    padded[:rows] = values
    out = np.empty((dims, bits, width), np.uint64)
    for b in range(bits):
        plane = np.ascontiguousarray(((padded >> b) & 1).astype(np.uint8).T)
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return out


def _blocks(rows: int, key: str):
    """Packs the rows ``key, vec_id, q`` into blocks of at most ``rows`` rows of one length."""

    def emit(ids: list, vectors: list) -> pd.DataFrame:
        values = np.stack(vectors).astype(np.float64)
        ids = np.array(ids, np.int64)
        return pd.DataFrame({key: [int(ids[0])], "ids": [ids.tobytes()], "data": [values.tobytes()], "dims": [values.shape[1]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, dims = [], [], None
        for frame in frames:
            for i, v in zip(frame["vec_id"], frame["q"], strict=True):
                if ids and (len(ids) == rows or len(v) != dims):
                    yield emit(ids, vectors)
                    ids, vectors = [], []
                dims = len(v)
                ids.append(i)
                vectors.append(v)
        if ids:
            yield emit(ids, vectors)

    return run


def build_index(vectors: DataFrame, block_rows: int = 8192) -> DataFrame:
    """The bit-sliced index: ``block, ids, slices, bits, dims`` in the shared folder."""

    def slice_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for packed in _blocks(block_rows, "block")(frames):
            values = np.frombuffer(packed["data"][0], np.float64).reshape(-1, packed["dims"][0])
            ids = np.frombuffer(packed["ids"][0], np.int64)
            order = np.argsort(ids, kind="stable")  # ties go to the smaller id, that is the lower lane
            values, ids = values[order], ids[order]
            bits = _bits(values)
            slices = _pack(_integers(values, bits), bits)
            yield pd.DataFrame({"block": packed["block"], "ids": [ids.tobytes()], "slices": [slices.tobytes()], "bits": [bits], "dims": packed["dims"]})

    packed = vectors.select("vec_id", "q").mapInPandas(slice_up, "block long, ids binary, slices binary, bits int, dims int")
    return stage(packed.withColumn("block", F.monotonically_increasing_id()), "topk-index")


def _signed_digits(x: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (weight, +1 or -1)."""
    out, at = [], 0
    while x:
        if x & 1:
            digit = 2 - (x & 3)
            out.append((at, digit))
            x -= digit
        x >>= 1
        at += 1
    return out


def bit_sliced_scores(planes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Two's complement slices of the inner products of a query with all rows of a block."""
    dims, bits, width = planes.shape
    bound = sum(abs(int(x)) for x in query) << (bits - 1)
    total = max(bound, 1).bit_length() + 2
    columns: list[list[np.ndarray]] = [[] for _ in range(total)]
    constant = 0
    for d in np.nonzero(query)[0]:
        for weight, sign in _signed_digits(int(query[d])):
            # A slice of negative weight is added inverted: -s = (1 - s) - 1 at its weight.
            for b in range(bits):
                if (sign < 0) != (b == bits - 1):
                    columns[weight + b].append(~planes[d, b])
                    constant -= 1 << (weight + b)
                else:
                    columns[weight + b].append(planes[d, b])
    constant &= (1 << total) - 1
    for weight in range(total):
        if constant >> weight & 1:
            columns[weight].append(np.full(width, _FULL, np.uint64))
    out = np.zeros((total, width), np.uint64)
    for weight in range(total):
        stack = np.array(columns[weight], np.uint64).reshape(-1, width)
        carries = []
        while len(stack) > 2:
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            stack = np.concatenate([ab ^ c, stack[3 * third :]])
        if len(stack) == 2:
            carries.append((stack[0] & stack[1])[None, :])
            out[weight] = stack[0] ^ stack[1]
        elif len(stack):
            out[weight] = stack[0]
        if carries and weight + 1 < total:
            columns[weight + 1].extend(np.concatenate(carries))
    return out


def select_top(slices: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Lanes of the ``k`` largest scores among ``allowed``; boundary ties go to lower lanes."""
    sure, open_ = np.zeros_like(allowed), allowed.copy()
    order = [~slices[-1], *slices[-2::-1]]  # the sign slice first, inverted
    for plane in order:
        hit = open_ & plane
        n = int(np.bitwise_count(sure | hit).sum())
        if n > k:
            open_ = hit
        else:
            sure |= hit
            open_ &= ~plane
            if n == k:
                return _lanes(sure)
    need = k - int(np.bitwise_count(sure).sum())
    return np.concatenate([_lanes(sure), _lanes(open_)[:need]])


def _lanes(bitmap: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[0]


def _order_key(score: int) -> str:
    """A string that sorts as the score does, whatever its size."""
    digits = f"{abs(score):x}"
    key = f"{len(digits):04x}{digits}"
    return "1" + key if score >= 0 else "0" + key.translate(str.maketrans("0123456789abcdef", "fedcba9876543210"))


def _best(index: tuple, queries: np.ndarray, numbers: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame | None:
    """The ``k`` best rows of one index block for each query of a block."""
    own, planes, bits = index
    lanes = np.zeros(planes.shape[2] * 64, bool)
    weights = [1 << b for b in range(bits - 1)] + [-(1 << (bits - 1))]
    found = []
    for number, query_id, row in zip(numbers, ids, queries, strict=True):
        wide = _bits(row)
        query = _integers(row, wide)
        lanes[: len(own)] = own != query_id
        top = select_top(bit_sliced_scores(planes, query), np.packbits(lanes, bitorder="little").view(np.uint64), k)
        if not len(top):
            continue
        # Exact products of the selected rows, read back from their slices.
        raw = (planes[:, :, top // 64] >> (top % 64).astype(np.uint64)) & np.uint64(1)
        if bits + wide + len(row).bit_length() <= 63:
            exact = (query.astype(np.int64) @ np.einsum("dbn,b->dn", raw.astype(np.int64), np.array(weights, np.int64))).tolist()
        else:
            rows = np.tensordot(raw.astype(object), np.array(weights, object), axes=(1, 0))
            exact = [sum(int(x) * int(y) for x, y in zip(query, column)) for column in rows.T]
        kept = [max(-_LONG - 1, min(_LONG, x)) for x in exact]
        found.append(pd.DataFrame({"query_no": number, "query_id": query_id, "vec_id": own[top], "score": kept, "order": [_order_key(x) for x in exact]}))
    return pd.concat(found, ignore_index=True) if found else None


def _stream_queries(k: int):
    """Rows sorted by slot and group: some index blocks, then the query blocks that they answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, index = None, []
        for frame in frames:
            for row in frame.itertuples():
                if (row.slot, row.group) != at:
                    at, index = (row.slot, row.group), []
                ids = np.frombuffer(row.ids, np.int64)
                if row.kind == 0:
                    index.append((ids, np.frombuffer(row.data, np.uint64).reshape(int(row.dims), int(row.bits), -1), int(row.bits)))
                    continue
                numbers = np.frombuffer(row.numbers, np.int64)
                queries = np.frombuffer(row.data, np.float64).reshape(-1, row.dims)
                for block in index:
                    if block[1].shape[0] == row.dims and (best := _best(block, queries, numbers, ids, k)) is not None:
                        yield best

    return run


def _query_blocks(rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, part in frame.groupby(frame["q"].map(len)):
                for at in range(0, len(part), rows):
                    some = part.iloc[at : at + rows]
                    data = np.stack(some["q"].to_list()).astype(np.float64)
                    yield pd.DataFrame({"ids": [some["vec_id"].to_numpy(np.int64).tobytes()], "numbers": [some["number"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()], "dims": [dims]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 8192, query_rows: int = 64, tasks: int | None = None, slot_blocks: int = 8) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of every query row.

    Both inputs are results of :func:`quantised`. Index blocks are dealt out by a
    hash to slots of about ``slot_blocks``, so that hardly a slot is empty and every
    query block is sent once for so many index blocks. ``tasks`` is the number of
    tasks to fill at least (by default that of the session's cores): where the
    index has fewer blocks, each is met by several groups of query blocks apart.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, block_rows)
    numbered = stage(queries.select("vec_id", "q").withColumn("number", F.monotonically_increasing_id()), "topk-queries")
    asked = stage(numbered.mapInPandas(_query_blocks(query_rows), "ids binary, numbers binary, data binary, dims int"), "topk-query-blocks")
    slots = max(1, -(-index.count() // slot_blocks))
    groups = max(1, min(-(-(tasks or 2 * spark.sparkContext.defaultParallelism) // slots), 64, asked.count()))
    none = F.lit(None)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).withColumn("group", each(groups)).select(
        "slot", "group", F.lit(0).alias("kind"), "ids", none.cast("binary").alias("numbers"), F.col("slices").alias("data"), "bits", "dims"
    )
    right = asked.withColumn("group", F.pmod(F.xxhash64("numbers"), F.lit(groups))).withColumn("slot", each(slots)).select(
        "slot", "group", F.lit(1).alias("kind"), "ids", "numbers", "data", none.cast("int").alias("bits"), "dims"
    )
    met = left.unionByName(right).repartition(min(slots * groups, 100_000), "slot", "group").sortWithinPartitions("slot", "group", "kind")
    best = met.mapInPandas(_stream_queries(k), "query_no long, query_id long, vec_id long, score long, `order` string")
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.col("order").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
