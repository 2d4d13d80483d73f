"""Secret scanning with a random forest that removes false positives.

1. **Dictionary and transitions.** Whole words of 2 to 12 letters are counted
   over all texts; the ``dictionary_words`` most frequent make the dictionary,
   and their letter pairs a table of character transitions.
2. **Candidates.** Assignments to credential names, well-known key formats,
   private keys in PEM form, and long tokens with digits are found in whole texts
   and at their whole length: quoted values up to the closing quote of their
   line, bare ones up to white space. Credential names may be part of a longer
   name (``DB_PASSWORD``). Features are length, character-class transitions,
   transition likelihood, dictionary coverage, shares of character classes,
   entropy, path-likeness of candidate and source, and the neighbouring words
   (credential names among them, and hashed). The name that a value is assigned
   to is no feature: the neighbour before an assignment is the word before its
   name.
3. **Labelled findings.** A table of human verdicts (``doc_id, start, label``) if
   there is one. Otherwise :func:`label_findings` labels by what the forest does
   not see: where a value stands (assigned to a credential name or in a known key
   format, or neither), and in how many documents. A value of a few documents
   that is assigned or in key format is taken for a secret; one that many
   documents share, or that stands bare, is not. The labels are noisy; the forest
   learns how the values of either side look, so that an assignment whose value
   looks like ordinary text is taken off, and a bare token that looks like a key
   is found.
4. **Forest.** A random forest is trained on at most about ``max_rows`` labelled
   findings (a documented bound; chosen by hash) and scores every candidate.

Edge cases: null and empty texts have no candidates; texts of any length are
read whole; overlapping candidates count once, leftmost first; repeated rows
repeat their findings; rows with a null id have findings like any other, but a
verdict is never theirs; without findings of both labels the score is 1 for
known key formats and credential assignments and 0 for the others; an empty
table gives an empty result; extra columns are ignored. The secret itself is not
returned, only its place and digest.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import stage

_CREDENTIAL = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth"
_KEY_FORMATS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
# Names may have parts before and after them. The part before starts where its run of characters does, so a run is read once.
_NAMED = rf"(?i:(?<![\w.-])[_.-]*+(?:[^\W_]+[_.-]+)*(?P<name>{_CREDENTIAL})(?:[_-]+[^\W_]+)*+[_-]*+(?![\w])[ ]{{0,2}}[=:][ ]{{0,2}})"
CANDIDATE = re.compile(
    rf"{_NAMED}(?:\"(?P<double>(?:[^\"\\\r\n]|\\.){{6,}}+)\"|'(?P<single>(?:[^'\\\r\n]|\\.){{6,}}+)'"
    # A quote within a bare value belongs to it if the value goes on behind it.
    r"|[\"']?(?P<bare>[^\s\"'](?:[^\s\"']|[\"'](?=[^\s\"',;:)}\]>])){5,}+))"
    rf"|(?P<format>\b(?:{_KEY_FORMATS})|-----BEGIN (?P<pem>[A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]+?-----END (?P=pem)PRIVATE KEY-----)"
    r"|(?P<long>(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.@-]*[0-9])[A-Za-z0-9+/_.@-]{8,})"
)
_WORDS = re.compile(r"[^\W\d_]+")
_LONGEST = 12  # letters of a dictionary word
_RARE = 2  # different texts that may share a secret
_WORD = re.compile(r"\w+")
NUMERIC = (
    "chars transitions likelihood coverage digits uppers lowers hexes symbols entropy distinct slashes dots at_sign "
    "source_depth source_digits quoted before_name after_name before_hash after_hash"
).split()


def dictionary(docs: DataFrame, words: int = 5000) -> dict[str, int]:
    """The most frequent words of 2 to 12 letters over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    counts.update(w for w in _WORDS.findall((text or "").lower()) if 2 <= len(w) <= _LONGEST)
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    found = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in found.orderBy(F.col("n").desc(), "word").limit(words).collect()}


def transition_table(words: dict[str, int]) -> dict[str, float]:
    pairs, singles = Counter(), Counter()
    for word, n in words.items():
        for a, b in zip(word, word[1:]):
            pairs[a + b] += n
            singles[a] += n
    return {p: math.log((n + 1) / (singles[p[0]] + 40)) for p, n in pairs.items()}


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _coverage(value: str, words: set[str]) -> float:
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(_LONGEST, len(low) - at), 2, -1):
            if low[at : at + n] in words:
                covered, at = covered + n, at + n
                break
        else:
            at += 1
    return covered / max(1, len(low))


def features(value: str, before: str, after: str, source: str | None, quoted: bool, words: set[str], pairs: dict[str, float]) -> list[float]:
    n = len(value)
    classes = [_class(c) for c in value]
    low = value.lower()
    share = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in share.values())
    hashed = lambda w: float(zlib.crc32(w.lower().encode()) % 32)
    credential = lambda w: float(bool(re.fullmatch(_CREDENTIAL, w, re.I)))
    return [
        float(n), sum(a != b for a, b in zip(classes, classes[1:])) / n,
        sum(pairs.get(low[i : i + 2], -8.0) for i in range(n - 1)) / max(1, n - 1), _coverage(value, words),
        classes.count(0) / n, classes.count(1) / n, classes.count(2) / n, sum(c in "0123456789abcdef" for c in low) / n, classes.count(3) / n,
        entropy, len(share) / n, float(value.count("/")), float(value.count(".")), float("@" in value),
        float((source or "").count("/")), float(sum(map(str.isdigit, source or ""))), float(quoted),
        credential(before), credential(after), hashed(before), hashed(after),
    ]


def candidates(docs: DataFrame, words: dict[str, int]) -> DataFrame:
    """One row per candidate of whole texts, with kind, place, digest and features; ``copy`` is the same for equal texts."""
    known, pairs = set(words), transition_table(words)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind_of_id}, copy long, start long, length long, kind string, value_sha256 string, " + ", ".join(f"`{f}` double" for f in NUMERIC)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "copy", "start", "length", "kind", "value_sha256", *NUMERIC]
        for frame in frames:
            rows = []
            for doc_id, copy, text, path in frame.itertuples(index=False):
                if not isinstance(text, str) or not text:
                    continue
                for m in CANDIDATE.finditer(text):
                    group = next(g for g in ("double", "single", "bare", "format", "long") if m[g] is not None)
                    kind = {"format": "format", "long": "token"}.get(group, "assignment")
                    start, end = m.span(group)
                    value = m[group]
                    before = _WORD.findall(text[max(0, m.start() - 40) : m.start()])[-1:]
                    after = _WORD.findall(text[end : end + 40])[:1]
                    x = features(value, (before or [""])[0], (after or [""])[0], path, text[end : end + 1] in "\"'" and end < len(text), known, pairs)
                    rows.append([doc_id, copy, start, len(value), kind, hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest(), *x])
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), "text", source.alias("source")).mapInPandas(run, schema)


def label_findings(found: DataFrame) -> DataFrame:
    """``label`` by place and by the number of different texts with the value, neither of which is a feature; copies of a text count once."""
    spread = found.groupBy("value_sha256").agg(F.approx_count_distinct("copy").alias("texts")).where(F.col("texts") > _RARE)
    shared = stage(spread.select("value_sha256", F.lit(True).alias("shared")), "secrets-shared")
    placed = F.col("kind").isin("assignment", "format") & F.col("shared").isNull()
    return found.join(shared, "value_sha256", "left").withColumn("label", placed.cast("int")).drop("shared")


def scan(docs: DataFrame, verdicts: DataFrame | None = None, max_rows: int = 20_000, trees: int = 30) -> DataFrame:
    """One row per candidate: ``doc_id, start, length, kind, value_sha256, score, is_secret``."""
    found = stage(candidates(docs, dictionary(docs)), "secrets-candidates")
    if verdicts is None:  # a value in many copies of a document is learnt once
        known = label_findings(found).withColumn("unit", F.col("value_sha256"))
    else:
        said = verdicts.where("label is not null").groupBy("doc_id", "start").agg(F.max("label").cast("int").alias("label"))
        known = found.join(said, ["doc_id", "start"]).withColumn("unit", F.concat_ws(":", F.col("doc_id").cast("string"), "start"))
    pick = F.pmod(F.xxhash64("unit"), F.lit(1_000_000)).alias("pick")
    known = known.select("unit", "label", pick, F.struct(*NUMERIC).alias("x"), F.struct("doc_id", "start").alias("place"))
    known = known.groupBy("unit", "pick").agg(F.max("label").alias("label"), F.min_by("x", "place").alias("x"))
    known = stage(known, "secrets-labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return _result(found.withColumn("score", F.col("kind").isin("assignment", "format").cast("double")))
    chosen = F.lit(False)
    for label, n in sizes.items():  # half of the bound for each label
        share = int(min(1.0, max_rows / 2 / n) * 1_000_000) + 1
        chosen = chosen | ((F.col("label") == label) & (F.col("pick") < share))
    assemble = VectorAssembler(inputCols=NUMERIC, outputCol="features")
    learn = assemble.transform(known.where(chosen).select("label", "x.*")).select("features", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=8, seed=7, minInstancesPerNode=2).fit(learn)
    scored = forest.transform(assemble.transform(found)).withColumn("score", vector_to_array("probability")[1])
    return _result(scored)


def _result(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "start", "length", "kind", "value_sha256", "score", (F.col("score") >= 0.5).alias("is_secret"))
