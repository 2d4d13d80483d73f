"""Exact de-duplication with a log-structured merge index of digests.

* **Memtables and runs.** Every input task is a memtable: it turns its
  documents into ``(digest, doc_id)`` entries, sorts them and flushes one
  Parquet file, a sorted run of level 0.
* **Filters.** A run's filter counts the entries in each of ``2**bits`` slots of
  digests. The filters are added up, and every digest is probed: where its slot
  holds one entry in all runs, no other can equal it, and it never goes into a
  merge. Spark sends the slots taken more than once to the runs while they are
  small; beyond that both sides are dealt by slot, and merges use that dealing.
* **Compaction.** The entries left are merged by digest, level by level: up to
  ``fanout`` runs make one sorted run of the next level, until one run is left.
  The entry with the smallest identifier survives a merge and carries the number
  of entries it stands for, so a digest that many documents share has at most
  one entry per run from level 1 on.
* **Byte verification.** A digest seen more than once is only a hit. The texts
  of hits meet the text of the surviving document, in slices of about
  ``SLICE_ROWS`` rows, and are compared byte by byte. Digests whose texts
  differ are grouped again by the text itself.

Texts equal up to runs of ASCII white space are equal. Edge cases: a null text
counts as empty; empty texts form one group; texts of any length are digested
and compared whole; a null ``doc_id`` sorts after all others, and its rows are
verified like others; rows that repeat a ``doc_id`` with an equal text are
separate members of the group, exactly one of which is kept; an empty table
gives an empty result; extra columns, whatever their names, are ignored by
:func:`decisions` and passed through by :func:`keep_first`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import fresh, scratch_dir, stage, text_or_empty

#: One run of white space that is not already a single space.
_UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


#: Members of a group whose texts meet the surviving text in one task.
SLICE_ROWS = 1000


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), _UNEVEN_SPACE, " ")


def flush_runs(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """Write one sorted run per input task; returns all entries, with the number of their ``run``.

    ``digest_chars`` shortens the index digest (tests force collisions with it).
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "exact-runs")
    entries = (
        docs.select("doc_id", F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("text_sha256"))
        .withColumn("digest", F.substring("text_sha256", 1, digest_chars))
        .withColumn("entry", F.monotonically_increasing_id())
        .withColumn("run", F.spark_partition_id())
    )
    entries.sortWithinPartitions("digest", "doc_id").write.parquet(path)
    return spark.read.schema(entries.schema).parquet(path)


def _slot(bits: int) -> Column:
    return F.xxhash64("digest").bitwiseAND(F.lit((1 << bits) - 1))


def taken_twice(runs: DataFrame, bits: int) -> DataFrame:
    """The slots that the filters of all runs together show as taken more than once: ``slot``."""
    return runs.groupBy(_slot(bits).alias("slot")).count().where("count > 1").select("slot")


def _merged(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One entry per key: the smallest identifier's, with the number of entries it stands for."""
    return entries.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def _as_entries(runs: DataFrame) -> DataFrame:
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "entry")
    return runs.withColumn("first", first).withColumn("n", F.lit(1).cast("long"))


def compact(runs: DataFrame, fanout: int = 64) -> DataFrame:
    """Merge runs level by level; per digest that occurs more than once, the surviving entry and the group's size."""
    rows = max(1, runs.count())
    bits = min(62, rows.bit_length() + 6)  # 64 slots or more an entry: about 1 in 64 unique digests is merged needlessly
    many = stage(taken_twice(runs, bits), "exact-filter")
    level = _as_entries(runs.withColumn("slot", _slot(bits)).join(many, "slot", "left_semi")).select("run", "slot", "digest", "first", "n")
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while left > fanout:
        left = -(-left // fanout)
        level = _merged(level.withColumn("run", F.floor(F.col("run") / fanout).cast("int")), ["run", "slot", "digest"])
        level = stage(level.sortWithinPartitions("run", "digest"), "exact-level")
    merged = _merged(level, ["slot", "digest"]).where("n > 1")
    return stage(
        merged.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.entry").alias("keep_entry"), F.col("n").alias("group_size")),
        "exact-compacted",
    )


def _member_texts(docs: DataFrame, members: DataFrame, digest_chars: int, broadcast_rows: int) -> DataFrame:
    """Normalised texts of the documents in ``members``, written once.

    Up to ``broadcast_rows`` members (32 bytes each) are sent to the scan, so
    that other texts are not moved; beyond, texts and members are shuffled. Rows
    without an id are found by their digest instead.
    """
    few = members.select("doc_id", F.xxhash64("digest").alias("key"), "keep_id", F.ceil(F.col("group_size") / SLICE_ROWS).cast("int").alias("slices"))
    own = few.where("doc_id is not null")
    if members.count() <= broadcast_rows:
        own = F.broadcast(own)
    digest = F.substring(F.sha2(F.encode("norm", "UTF-8"), 256), 1, digest_chars)
    found = docs.select("doc_id", "text").join(own, "doc_id").select("doc_id", "key", "keep_id", "slices", normalised().alias("norm"))
    found = found.withColumn("digest", digest).where(F.xxhash64("digest") == F.col("key"))
    nameless = docs.where("doc_id is null").select(normalised().alias("norm")).withColumn("digest", digest).withColumn("key", F.xxhash64("digest"))
    nameless = nameless.join(few.where("doc_id is null").drop("doc_id"), "key")
    columns = ["doc_id", "keep_id", "slices", "norm", "digest"]
    return stage(found.select(columns).unionByName(nameless.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).select(columns)), "exact-texts")


def decisions(docs: DataFrame, digest_chars: int = 64, broadcast_rows: int = 100_000, fanout: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    docs = docs.select("doc_id", "text")
    runs = flush_runs(docs, digest_chars)
    groups = compact(runs, fanout)
    # Stored before it is made distinct: the join's hot digests can then be split, and (digest, doc_id) has none.
    members = stage(runs.join(groups, "digest").select("digest", "doc_id", "keep_id", "group_size"), "exact-hits")
    members = stage(members.distinct(), "exact-members")

    texts = _member_texts(docs, members, digest_chars, broadcast_rows)
    hits = texts.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.length("norm"), F.monotonically_increasing_id()), F.col("slices")).cast("int"))
    keepers = (
        texts.where("doc_id <=> keep_id").groupBy("digest").agg(F.min("norm").alias("kept_norm"), F.max("slices").alias("slices"))
        .select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    )
    differing = stage(
        hits.join(keepers, ["digest", "slice"]).where("norm <> kept_norm").select("digest").distinct(), "exact-differing"
    )

    found = runs.join(groups, "digest", "left")
    own = F.col("keep_entry").isNull() | (F.col("keep_entry") == F.col("entry"))
    out = found.select(
        "doc_id", F.when(F.col("keep_entry").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), own.alias("kept"), "text_sha256", "digest", "entry",
    )
    if differing.isEmpty():
        return out.drop("digest", "entry")
    # Digests that stand for several texts: group their entries by the whole text's own digest.
    apart = runs.join(differing, "digest", "left_semi")
    exact = _merged(_as_entries(apart), ["digest", "text_sha256"])
    mended = apart.join(exact, ["digest", "text_sha256"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first.entry") == F.col("entry")).alias("kept"), "text_sha256"
    )
    return out.join(differing, "digest", "left_anti").drop("digest", "entry").unionByName(mended)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = stage(decisions(docs, **options), "exact-decisions")
    rows = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("copies"))
    repeated = rows.where("copies > 1")
    if found.where("doc_id is null").isEmpty() and repeated.isEmpty() and found.select("doc_id").distinct().count() == found.count():
        return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    # Repeated ids: decide by (id, text) and keep one row of each pair.
    sha, id_, text = (fresh(name, docs.columns) for name in ("sha", "id", "of_text"))
    keyed = docs.withColumn(sha, F.sha2(F.encode(normalised(), "UTF-8"), 256))
    stay = rows.where("any_kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(text))
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay[id_]) & (keyed[sha] == stay[text]), "left_semi")
    return kept.dropDuplicates(["doc_id", sha]).select(docs.columns)
