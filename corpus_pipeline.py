"""A corpus pipeline of five stages, each one operator of the training-data subpackage.

Every stage takes what the one before kept; its decisions take effect. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import exact_dedup, packing, pii, simhash, toxicity
from pactlake.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    This and the other stages take nulls in any column, empty and very long
    texts, repeated rows, empty tables and extra columns of any name as the
    operator that they call defines them; extra columns pass through. Rows with a
    null ``doc_id`` are never near copies.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates the document with the smallest id stays.

    Near duplicates are texts whose sets of 5-word shingles have a Jaccard
    similarity of 0.8 or more; it is computed for every pair that SimHash
    proposes. Such texts differ in up to about ten bits of a fingerprint, more
    than an exact search reaches at scale. A view within six bits proposes about
    half of the short texts that are just alike; six views propose nearly all of
    them (figures in the README).
    """
    return simhash.keep_one_alike(docs, similarity=0.8, words=5, radius=6, views=6)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; ``n_chars`` follows the new text."""
    out = pii.replace(docs, pii.session_key(spark))
    changed = F.when(F.col(out.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: The classifier and the bit-sliced links have no SQL form; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
