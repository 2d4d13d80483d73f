"""SimHash near-duplicates with bit-sliced Hamming comparison.

* **Fingerprints.** Per document the XXH64 values (seed 42) of its 3-word
  shingles vote on 64 bits; a bit is set if over half of the values have it.
* **Views.** Further fingerprints of a text come from the same shingles with
  their hash values mixed anew. Linking by any view finds more of the texts
  whose distance in one view is just past the radius.
* **Candidates.** Two fingerprints that differ in at most ``radius`` bits agree
  on at least ``m - radius`` of ``m`` bit blocks. Each distinct fingerprint is
  dealt out under every choice of ``m - radius`` blocks, so no pair is missed;
  ``m`` grows with the number of fingerprints, which changes cost, not results.
* **Bit-sliced comparison.** A bucket's fingerprints are stored as 64 vertical
  bit planes. Distances of one fingerprint to 64 others are updated by a
  carry-save counter of a few bitwise operations per plane; rows of a block are
  abandoned once every lane has passed the radius. A block emits a spanning
  forest of its links, never its pairs.
* **Components.** Alternating large-star and small-star steps over the forest's
  edges, each step written to the shared folder.
* **Exact rule.** :func:`keep_one_alike` takes the components as candidates only.
  Equal shingle sets are alike by their hash; all other pairs of a component are
  compared by the exact Jaccard similarity of their sets, and components are
  formed again from the pairs that reach it. A component too large for one task
  is first thinned out: its sets meet a few of their own, and those that are
  alike to these are one class, inside which nothing is compared any more. The
  rest is found by prefixes: sets whose similarity is ``t`` or more share one of
  their ``size - ceil(t * size) + 1`` rarest shingles, so that only sets with
  such a shingle in common meet, and only if not both are in the large class.

Edge cases: null or empty texts have fingerprint zero and link like any other;
texts of one or two words are one shingle; texts of any length are read whole; a
component whose documents all have null ``doc_id`` has a null ``component_id``;
repeated rows keep their own rows; an empty table gives an empty result; extra
columns are ignored by :func:`near_duplicates` and pass through the others,
whatever their names. For the exact rule texts without words have the empty set,
which only equals itself, and texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import fresh, stage

_LANES = np.uint64(0x0101010101010101)
_STEP = 0x9E3779B97F4A7C15  # this and the two factors of _of_view: the public SplitMix64 mixer


def _shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hash_ = xxhash.xxh64_intdigest
    return np.fromiter((hash_(s, seed) for s in shingles), np.uint64)


def _of_view(values: np.ndarray, view: int) -> np.ndarray:
    """The hash values of a further view: each value mixed anew. View 0 takes them as they are."""
    if not view:
        return values
    values = values + np.uint64(view * _STEP % (1 << 64))
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _majority(values: np.ndarray) -> int:
    votes = np.zeros((8, 8), np.int64)  # [bit within byte, byte]
    for at in range(0, len(values), 255):  # 255 votes fit in a byte lane
        part = values[at : at + 255]
        for bit in range(8):
            votes[bit] += ((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64).reshape(1).view(np.uint8)
    majority = 2 * votes > len(values)
    return sum(1 << (8 * byte + bit) for bit in range(8) for byte in range(8) if majority[bit, byte])


def fingerprint(text: str | None, words: int = 3, seed: int = 42, view: int = 0) -> int:
    """64-bit SimHash of a whole text; 0 if it has no words."""
    return _majority(_of_view(_shingle_hashes(text, words, seed), view))


def _shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(_shingle_hashes(text, words, 42))


def _set_id(values: np.ndarray) -> int:
    """Hash of a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes())).astype(np.int64))


def fingerprints(docs: DataFrame, views: int = 1, set_words: int = 0) -> DataFrame:
    """``doc_id, digest, fp`` (the fingerprint's bits as a signed long) of whole texts; further views are ``fp1``, ``fp2``, ...

    ``digest`` tells rows of one id apart. With ``set_words``, also ``node`` and
    ``size``: hash and size of the set of shingles of so many words.
    """
    names = ["fp", *(f"fp{view}" for view in range(1, views)), *(["node", "size"] if set_words else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = np.zeros((len(names), part.num_rows), np.uint64)
                for i, text in enumerate(part.column(2).to_pylist()):
                    hashes = _shingle_hashes(text, 3, 42)
                    values[:views, i] = [_majority(_of_view(hashes, view)) for view in range(views)]
                    if set_words:
                        own = _shingle_set(text, set_words)
                        values[views:, i] = np.array([_set_id(own), len(own)], np.int64).view(np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *map(pa.array, values.view(np.int64))], names=["doc_id", "digest", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _digest().alias("digest"), "text").mapInArrow(run, f"doc_id {kind}, digest string, " + ", ".join(f"{name} long" for name in names))


def _digest() -> Column:
    """128 bits of a text; rows of one id that differ in their texts differ in it."""
    return F.md5(F.col("text"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text are those of ``gone`` (``doc_id, digest``); other rows of such an id stay."""
    digest = fresh("digest", docs.columns)
    gone = gone.select("doc_id", F.col("digest").alias(digest)).distinct()
    marked = docs.withColumn(digest, _digest())
    same = (marked["doc_id"] == gone["doc_id"]) & marked[digest].eqNullSafe(gone[digest])
    return marked.join(gone, same, "left_anti").select(docs.columns)


def _planes(values: np.ndarray) -> np.ndarray:
    """Vertical layout: 64 rows of bits, 64 fingerprints to a word."""
    width = -(-len(values) // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each index's first of its component) after the links ``a, b``."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _spanning_forest(values: np.ndarray, radius: int, chunk_words: int = 16384) -> np.ndarray:
    """For each fingerprint of a block, the index of its component's first member."""
    n = len(values)
    planes = _planes(values)
    width = planes.shape[1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    slices = max(1, radius.bit_length())
    start = (1 << slices) - 1 - radius  # counters overflow on passing the radius
    parent = np.arange(n)
    lane_bits = np.arange(width * 64)
    step = max(1, chunk_words // width)
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        # Only later fingerprints are of interest: lanes up to the own one, and padding, count as passed.
        passed = np.packbits((lane_bits[None, :] <= rows[:, None]) | (lane_bits[None, :] >= n), axis=1, bitorder="little").view(np.uint64)
        counters = [np.full(passed.shape, full if start >> k & 1 else 0, np.uint64) for k in range(slices)]
        for bit in range(64):
            own = (values[rows] >> np.uint64(bit)) & np.uint64(1)
            carry = planes[bit][None, :] ^ (own * full)[:, None]
            for counter in counters:
                held = counter & carry
                counter ^= carry
                carry = held
            passed |= carry
            if bit % 8 == 7:
                alive = (passed != full).any(axis=1)
                if not alive.any():
                    rows = rows[:0]
                    break
                if alive.sum() < 0.75 * len(alive):
                    rows, passed, counters = rows[alive], passed[alive], [c[alive] for c in counters]
        if not len(rows):
            continue
        near = np.unpackbits(np.ascontiguousarray(~passed).view(np.uint8), axis=1, bitorder="little")
        which, lane = np.nonzero(near)
        parent = _joined(parent, rows[which], lane)
    return parent


def _block_edges(values: np.ndarray, radius: int) -> pd.DataFrame:
    parent = _spanning_forest(values.view(np.uint64), radius)
    child = np.nonzero(parent != np.arange(len(values)))[0]
    return pd.DataFrame({"u": values[child], "v": values[parent[child]]})


def _compare_sorted(radius: int, least: int):
    """Compare each bucket of rows sorted by view and bucket; small neighbouring buckets of a view share a block."""

    def edges(view: int, values: np.ndarray) -> pd.DataFrame:
        return _block_edges(np.unique(values), radius).assign(view=view)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"view": [], "bucket": [], "fp": []}, dtype=np.int64)
        for frame in frames:
            held = pd.concat([held, frame], ignore_index=True)
            view, bucket, fps, at = held["view"].to_numpy(), held["bucket"].to_numpy(), held["fp"].to_numpy(), 0
            turns = np.nonzero(view[1:] != view[:-1])[0] + 1
            ends = np.union1d(np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, turns)  # ends of complete buckets
            while at < len(held):
                k, turn = np.searchsorted(ends, at + least), np.searchsorted(turns, at, "right")
                end = min([int(x[i]) for x, i in ((ends, k), (turns, turn)) if i < len(x)], default=None)
                if end is None:
                    break
                yield edges(view[at], fps[at:end])
                at = end
            held = held.iloc[at:]
        if len(held):
            yield edges(held["view"].iloc[0], held["fp"].to_numpy())

    return run


def links(distinct: DataFrame, radius: int = 3, bucket_rows: int = 4096, blocks: int | None = None) -> DataFrame:
    """Edges ``view, u, v`` whose components are, in each view, those of all pairs within ``radius``.

    ``distinct`` has one row per distinct ``view, fp``. Buckets of over
    ``bucket_rows`` are cut into slices and every pair of slices is compared
    in a cell of its own, so a hot bucket is many bounded tasks.
    """
    n = distinct.groupBy("view").count().agg(F.max("count")).first()[0] or 0
    blocks = blocks or next((m for m in range(radius + 1, radius + 3) if n <= bucket_rows // 4 << 64 * (m - radius) // m), radius + 3)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    buckets = F.array(*[F.xxhash64(F.lit(i), "view", F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    dealt = distinct.select("view", "fp", F.explode(buckets).alias("bucket"))
    large = stage(dealt.groupBy("bucket").count().where(F.col("count") > bucket_rows), "simhash-large")
    if not large.isEmpty():
        cells = F.ceil(F.col("count") * 2 / bucket_rows).cast("int")
        dealt = dealt.join(large, "bucket", "left").withColumn("cells", F.coalesce(cells, F.lit(1)))
        own = F.pmod(F.xxhash64("fp", F.lit("cell")), F.col("cells"))
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)))
        cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select("view", F.when(F.col("cells") > 1, cell).otherwise(F.col("bucket")).alias("bucket"), "fp")
    sorted_ = dealt.select(F.col("view").cast("long").alias("view"), "bucket", "fp").repartition("bucket").sortWithinPartitions("view", "bucket", "fp")
    return sorted_.mapInPandas(_compare_sorted(radius, 512), "u long, v long, view long").distinct().select("view", "u", "v")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges``; the root is the component's smallest node.

    The smallest neighbours are stored before they are joined, so that both
    sides of a join are plain shuffles and Spark can split a hot node.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _links_of_views(prints: DataFrame, radius: int, bucket_rows: int, views: int) -> DataFrame:
    """Links in any view between fingerprints ``fp``: each of a view's own stands for its smallest ``fp``. All views are compared in one pass."""
    own = F.explode(F.array(*[F.struct(F.lit(view).alias("view"), F.col(f"fp{view}" if view else "fp").alias("own")) for view in range(views)])).alias("o")
    pairs = stage(prints.select("fp", own).select("fp", "o.*").distinct(), "simhash-views")
    first = stage(pairs.groupBy("view", "own").agg(F.min("fp").alias("first")), "simhash-first")
    same = pairs.join(first, ["view", "own"]).select(F.col("fp").alias("u"), F.col("first").alias("v")).where("u <> v")
    near = stage(links(first.select("view", F.col("own").alias("fp")), radius, bucket_rows), "simhash-near")
    near = near.join(first.select("view", F.col("own").alias("u"), F.col("first").alias("a")), ["view", "u"])
    near = near.join(first.select("view", F.col("own").alias("v"), F.col("first").alias("b")), ["view", "v"])
    return same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _rooted(prints: DataFrame, radius: int, bucket_rows: int, views: int) -> DataFrame:
    """``fp, first_id, root`` of each distinct ``fp`` of stored ``prints``, linked in any view."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    if views > 1:
        edges = _links_of_views(prints, radius, bucket_rows, views)
    else:
        edges = links(distinct.select(F.lit(0).alias("view"), "fp"), radius, bucket_rows).select("u", "v")
    found = components(edges)
    return stage(
        distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")),
        "simhash-rooted",
    )


def _classes(docs: DataFrame, radius: int, bucket_rows: int, views: int) -> DataFrame:
    """``doc_id, digest, fp, component_id`` of every row."""
    prints = stage(fingerprints(docs, views), "simhash-prints")
    rooted = _rooted(prints, radius, bucket_rows, views)
    named = stage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-named")
    by_print = stage(rooted.join(named, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(by_print, "fp").select("doc_id", "digest", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, bucket_rows: int = 4096, views: int = 1) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    With more than one view, documents link that are within ``radius`` in any
    of them; ``fingerprint`` is the first.
    """
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _classes(docs, radius, bucket_rows, views).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, bucket_rows: int = 4096, views: int = 1) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Rows whose id names their component stay, and so do rows with a null id.
    Of rows that share an id each is decided by its own text.
    """
    return _without(docs, _classes(docs, radius, bucket_rows, views).where("doc_id <> component_id"))


def _alike(sets: list[np.ndarray], similarity: float, columns: int = 8192) -> np.ndarray:
    """For each set, the index of the first member of its component of pairs with Jaccard ``similarity`` or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column) > 1
    rank = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(n), sizes)[shared[column]]
    column = rank[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.int64)
    for first in range(0, int(shared.sum()), columns):  # float32 counts up to 2**24 exactly, far beyond one chunk
        a, b = np.searchsorted(column, [first, first + columns])
        held = np.zeros((n, columns), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        common += (held @ held.T).astype(np.int64)
    union = np.maximum(sizes[:, None] + sizes[None, :] - common, 1)
    a, b = np.nonzero(np.triu(common / union >= similarity, 1))
    return _joined(np.arange(n), a, b)


def _compare_cells(similarity: float):
    """Compare each cell of rows sorted by cell; a cell emits a spanning forest of its alike pairs."""

    def forest(nodes: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        own = dict(zip(nodes, sets))
        nodes = np.array(sorted(own), np.int64)
        parent = _alike([own[int(node)] for node in nodes], similarity)
        child = np.nonzero(parent != np.arange(len(nodes)))[0]
        return pd.DataFrame({"u": nodes[child], "v": nodes[parent[child]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, nodes, sets, out = None, [], [], []
        for frame in frames:
            for cell, node, values in zip(frame["cell"], frame["node"], frame["values"]):
                if cell != at:
                    if len(nodes) > 1:
                        out.append(forest(nodes, sets))
                    at, nodes, sets = cell, [], []
                nodes.append(node)
                sets.append(np.asarray(values, np.int64))
            if out:
                yield pd.concat(out)
                out = []
        if len(nodes) > 1:
            yield forest(nodes, sets)

    return run


def _in_cells(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges among the sets of each cell of ``dealt`` (``cell, node``)."""
    rows = dealt.join(sets.select("node", "values"), "node").select("cell", "node", "values")
    return rows.repartition("cell").sortWithinPartitions("cell", "node").mapInPandas(_compare_cells(similarity), "u long, v long")


def _to_pivots(sets: DataFrame, similarity: float, pivots: int, slice_rows: int) -> DataFrame:
    """Edges of every set of a crowd with those of ``pivots`` of the crowd's own that are alike to it."""
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    slices = F.ceil(F.col("n") / slice_rows)
    share = F.least(F.lit(1.0), 2.0 * pivots / F.col("n"))
    few = sets.join(sizes, "root").where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 30)) < share * (1 << 30))  # about two for one
    order = Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit("order")), "node")
    few = few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= pivots)
    few = stage(few.select("root", F.col("node").alias("pivot"), F.col("values").alias("theirs"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice")), "simhash-pivots")
    own = sets.join(sizes.select("root", slices.alias("slices")), "root").withColumn("slice", F.pmod(F.xxhash64("node", F.lit("slice")), F.col("slices")))
    met = own.join(few, ["root", "slice"]).where("node <> pivot")
    common = F.size(F.array_intersect("values", "theirs"))
    alike = common / (F.size("values") + F.size("theirs") - common) >= similarity
    return met.where(alike).select(F.col("node").alias("u"), F.col("pivot").alias("v"))


def _crowded_links(sets: DataFrame, similarity: float, cell_rows: int, pivots: int = 12) -> DataFrame:
    """Edges of crowds too large for one cell. ``sets`` is a stored table of ``root, node, values``."""
    first = stage(_to_pivots(sets, similarity, pivots, 4 * cell_rows), "simhash-to-pivots")
    classes = components(first)
    placed = stage(sets.select("root", "node").join(classes.select("node", F.col("root").alias("class")), "node", "left"), "simhash-placed")
    main = placed.where("class is not null").groupBy("root", "class").count().groupBy("root").agg(F.max_by("class", F.struct("count", "class")).alias("main"))
    placed = stage(placed.join(main, "root", "left").select("root", "node", F.coalesce(F.col("class") == F.col("main"), F.lit(False)).alias("settled")), "simhash-settled")
    open_roots = placed.where("not settled").select("root").distinct()
    placed = placed.join(open_roots, "root", "left_semi")
    # The rarest shingles of each set, by the crowd's own counts.
    each = sets.join(placed, ["root", "node"]).select("root", "node", "settled", F.size("values").alias("size"), F.explode("values").alias("token"))
    each = stage(each, "simhash-tokens")
    counts = stage(each.groupBy("root", "token").agg(F.count(F.lit(1)).alias("n")), "simhash-token-counts")
    ordered = F.array_sort(F.collect_list(F.struct("n", "token")))
    length = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    prefix = F.slice(ordered, F.lit(1), length.cast("int"))
    rare = each.join(counts, ["root", "token"]).groupBy("root", "node", "settled", "size").agg(prefix.alias("p"))
    keys = stage(rare.select("node", "settled", F.explode("p").alias("t"), "root").where("t.n > 1").select("node", "settled", F.xxhash64("root", "t.token").alias("key")), "simhash-prefixes")
    sizes = keys.groupBy("key").agg(F.count_if(~F.col("settled")).alias("free"), F.count_if("settled").alias("rest")).where("free > 0 and free + rest > 1")
    keys = keys.join(sizes, "key")
    # Free sets meet each other and the settled ones; settled sets do not meet each other.
    half = F.lit(cell_rows // 2)
    free_cells, rest_cells = F.ceil(F.col("free") / half), F.ceil(F.col("rest") / half)
    one = F.col("free") + F.col("rest") <= cell_rows
    own = F.pmod(F.xxhash64("node", F.lit("cell")), F.greatest(F.lit(1).cast("long"), F.when(F.col("settled"), rest_cells).otherwise(free_cells)))
    keys = keys.select("key", "node", "settled", one.alias("one"), own.alias("own"), free_cells.alias("free_cells"), rest_cells.alias("rest_cells"))
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")
    among = F.when(~F.col("settled"), F.transform(F.sequence(zero, F.col("free_cells") - 1), lambda j: F.xxhash64("key", F.lit("free"), F.least("own", j), F.greatest("own", j)))).otherwise(none)
    across = (
        F.when(F.col("settled"), F.transform(F.sequence(zero, F.col("free_cells") - 1), lambda i: F.xxhash64("key", F.lit("both"), i, "own")))
        .when(F.col("rest_cells") > 0, F.transform(F.sequence(zero, F.greatest(zero, F.col("rest_cells") - 1)), lambda j: F.xxhash64("key", F.lit("both"), "own", j))).otherwise(none)
    )
    cells = F.when(F.col("one"), F.array("key")).otherwise(F.concat(among, across))
    dealt = keys.select("node", F.explode(cells).alias("cell"))
    return first.unionByName(_in_cells(dealt, sets, similarity))


def alike_links(docs: DataFrame, crowds: DataFrame, similarity: float, words: int, cell_rows: int = 512, cell_bytes: int = 1 << 26) -> DataFrame:
    """Edges ``u, v`` whose components are those of all pairs of a crowd with Jaccard ``similarity`` or more.

    ``crowds`` is a stored table of ``root, node, size, first_id``: the distinct
    shingle sets of each candidate component, and a document that has the set.
    """
    sizes = crowds.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("size")).alias("bytes"))
    small = (F.col("n") <= cell_rows) & (F.col("bytes") <= cell_bytes)
    members = stage(crowds.join(sizes.where("n > 1"), "root").select("root", "node", "first_id", small.alias("small")), "simhash-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [_shingle_set(text, words) for text in part.column(1).to_pylist()]
                arrays = [part.column(0), pa.array(map(_set_id, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["first_id", "node", "values"])

    wanted = docs.select("doc_id", "text").join(members.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = wanted.mapInArrow(run, f"first_id {kind}, node long, values array<long>")
    # One row per set: a set whose texts have several fingerprints may be in several crowds.
    sets = stage(members.join(found, ["first_id", "node"]).select("root", "node", "small", "values"), "simhash-sets")
    whole = _in_cells(sets.where("small").select(F.col("root").alias("cell"), "node"), sets.where("small").dropDuplicates(["node"]), similarity)
    large = sets.where("not small")
    if large.isEmpty():
        return whole
    return whole.unionByName(_crowded_links(large, similarity, cell_rows))


def keep_one_alike(docs: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 3, bucket_rows: int = 4096, views: int = 1, cell_rows: int = 512) -> DataFrame:
    """The documents that stay, one of each component of texts that are alike, with all their columns.

    Two texts are alike if the Jaccard similarity of their sets of ``words``-word
    shingles is ``similarity`` or more. Equal sets are always found; other pairs
    are found within components of SimHash links. The smallest id of a component
    stays; rows with a null id stay. Of rows that share an id each is decided by
    its own text.
    """
    prints = stage(fingerprints(docs, views, words).where("doc_id is not null"), "simhash-prints")
    # A smaller set reaches the similarity with no set but itself: one more member is too much.
    open_ = stage(prints.where(F.col("size") / (F.col("size") + 1) >= similarity), "simhash-open")
    rooted = _rooted(open_, radius, bucket_rows, views)
    crowds = open_.join(rooted.select("fp", "root"), "fp").groupBy("root", "node").agg(F.min("doc_id").alias("first_id"), F.max("size").alias("size"))
    found = components(alike_links(docs, stage(crowds, "simhash-crowds"), similarity, words, cell_rows))
    classes = prints.select("doc_id", "digest", "node").join(found, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("class"))
    classes = stage(classes, "simhash-alike")
    first = classes.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return _without(docs, classes.join(first, "class").where("doc_id <> component_id"))
