"""Canonical documents: text, hash, segments, pages, and positional joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.spans import let, match_spans
from pactlake.functions.text import MAX_CHARS, canonical, fold_with_offsets, folded

_AFTER = r"(?=[).\s])"
SEGMENT = r"(?im)^[ \t]*(?:(?:clause|section|article|schedule|annexure|appendix)\s+)?((?:\d+(?:\.\d+)*)|(?:\([a-z]{1,3}\))|(?:[IVXLC]+\.))" + _AFTER
REFUSED = "This does not look like a contract."


def canonical_documents(raw: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``doc_id, text, truncated, hash``."""
    whole = raw.select("doc_id", canonical(F.col("text")).alias("whole"))
    return whole.select("doc_id", *identity(F.col("whole"), max_chars))


def identity(whole: Column, max_chars: int = MAX_CHARS) -> list[Column]:
    """P2, P3 of a canonical text: ``text, truncated, hash``."""
    text = F.substring(whole, 1, max_chars)
    return [text.alias("text"), (F.length(whole) > max_chars).alias("truncated"), F.sha2(F.encode(text, "UTF-8"), 256).alias("hash")]


def dedup_by_hash(requests: DataFrame) -> DataFrame:
    """One analysis for equal questions; every request learns whose result it reuses."""
    key = Window.partitionBy("hash", "language", "level", "declared_type").orderBy("ts", "request_id")
    return requests.withColumn("analysed_as", F.first("request_id").over(key)).withColumn("reused", F.col("request_id") != F.col("analysed_as"))


def legal_gate(docs: DataFrame, classes: DataFrame, known_types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """P5: documents with their effective type, and refusals with their reason."""
    joined = docs.join(classes, "doc_id")
    declared = F.when(F.col("declared_type").isin(*known_types), F.col("declared_type"))
    passed = joined.where("is_legal").withColumn("document_type", F.coalesce(declared, "classified_type"))
    refused = joined.where(~F.col("is_legal")).select("doc_id", F.coalesce("reason", F.lit(REFUSED)).alias("reason"))
    return passed, refused


def segments_of(text: Column) -> Column:
    """X2 as an array, so that no shuffle is needed: a segment runs to the next one's start."""

    def build(pairs: Column) -> Column:
        return F.transform(
            pairs,
            lambda p, i: F.struct(
                (i + 1).alias("ord"), F.concat(F.lit("seg-"), (i + 1).cast("string"), F.lit("-"), F.regexp_replace(p["label"], r"[^\w.]", "")).alias("segment_id"),
                p["label"].alias("label"), p["start"].alias("start"), F.coalesce(F.try_element_at(pairs, (i + 2).cast("int"))["start"], F.length(text)).alias("end"),
            ),
        )

    label = SEGMENT.replace(_AFTER, r"\z")  # a match ends where its label does
    pairs = F.transform(match_spans(text, SEGMENT), lambda s: F.struct(s["start"].alias("start"), F.regexp_extract(s["text"], label, 1).alias("label")))
    return let(pairs, build)


def find_segments(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(segments_of(F.col("text"))).alias("s")).select("doc_id", "s.*")


def page_marks(docs: DataFrame) -> DataFrame:
    """Places of pages (``pages`` is an array of texts) found one after the other by their first 40 characters."""
    probes = F.transform("pages", lambda p, i: F.struct((i + 1).alias("number"), F.substring(canonical(p), 1, 40).alias("probe")))
    none = F.array().cast("array<struct<number:int,start:int>>")

    def fold(state: Column, p: Column) -> Column:
        place = F.call_function("locate", p["probe"], F.col("text"), state["pos"] + 1) - 1
        good = (F.length(p["probe"]) >= 8) & (place >= 0)
        return F.struct(
            F.when(good, place + F.length(p["probe"])).otherwise(state["pos"]).alias("pos"),
            F.when(good, F.concat(state["marks"], F.array(F.struct(p["number"].alias("number"), place.alias("start"))))).otherwise(state["marks"]).alias("marks"),
        )

    marks = F.aggregate(probes, F.struct(F.lit(0).alias("pos"), none.alias("marks")), fold, lambda s: s["marks"])
    rows = docs.withColumn("marks", marks)
    ended = F.transform(
        "marks",
        lambda m, i: F.struct(m["number"].alias("page_number"), m["start"].alias("start"), F.coalesce(F.try_element_at("marks", (i + 2).cast("int"))["start"], F.length("text")).alias("end")),
    )
    return rows.select("doc_id", F.explode(ended).alias("m")).select("doc_id", "m.*")


def place_at(offsets: DataFrame, places: DataFrame, keep: list[str]) -> DataFrame:
    """The segment or page that contains an offset: as of the offset, the last place that began.

    Places of a document do not overlap. Offsets and places are dealt by document,
    sorted together and passed through once, so a document with many of both
    costs their sum, not their product.
    """
    began = places.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("kind"), F.struct("end", *keep).alias("place"))
    asked = offsets.select("doc_id", F.col("offset").alias("pos"), F.lit(1).alias("kind"), F.struct(*offsets.columns).alias("row"))
    order = Window.partitionBy("doc_id").orderBy("pos", "kind")
    both = began.unionByName(asked, allowMissingColumns=True).withColumn("last", F.last("place", ignorenulls=True).over(order)).where("kind = 1")
    inside = F.coalesce(F.col("doc_id").isNotNull() & (F.col("pos") < F.col("last.end")), F.lit(False))
    return both.select("row.*", *[F.when(inside, F.col("last")[c]).alias(c) for c in keep])


def site_enrich(spans: DataFrame, docs: DataFrame, segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Quote, segment, page and a description of a span."""
    rows = spans.withColumn("offset", F.col("start")).join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.withColumn("quote", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    rows = place_at(place_at(rows, segments, ["segment_id", "label"]), pages, ["page_number"])
    place = (
        F.when(F.col("label").isNotNull(), F.concat(F.lit("clause "), F.regexp_replace("label", r"\.$", "")))
        .when(F.col("page_number").isNotNull(), F.concat(F.lit("page "), F.col("page_number").cast("string"))).otherwise("elsewhere in the document")
    )
    return rows.drop("offset").withColumn("place", place)


def fold_offsets(docs: DataFrame) -> DataFrame:
    """P8."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [fold_with_offsets(t or "") for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "folded": [p[0] for p in pairs], "offsets": [p[1] for p in pairs]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, folded string, offsets array<int>")


def fold_text(docs: DataFrame) -> DataFrame:
    """P7."""
    return docs.select("doc_id", folded(F.col("text")).alias("folded"))
