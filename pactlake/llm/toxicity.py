"""Toxicity by weak supervision.

1. **Learning rows.** Labelled documents that are not held out
   (crc32 of the id's text mod 5 is not 0), at most about ``max_rows`` of them
   (chosen by a hash of the id; the bound is a parameter). No row is left out;
   rows whose three smallest shingle hashes agree are copies of one text and
   share the weight of one row, so that copies do not vote twice.
2. **Voters.** The annotators of the learning rows, a general lexicon, text
   patterns, and lexicons induced from labelled rows, wide and narrow, for whole
   words and for word beginnings. A row hears only the lexicons induced without
   its own fold. Each voter says toxic, clean or nothing about a text.
3. **Label model.** A generative model of the votes: class prior, each voter's
   accuracy, and correlations as a tree of pairwise dependencies (maximum
   conditional mutual information), fitted by expectation-maximisation over
   weighted counts of vote patterns. It starts from the texts that half of the
   lexicons or more call toxic; annotators are one voter like the others.
4. **End model.** A linear classifier (logistic regression) over the rates of
   terms per hundred words, trained on the posterior labels as weights, scores
   every whole text.

A term is a word or a word's beginning. A single telling word in a long text is
chance, so terms count by their rate, in lexicons, votes and features alike.

Labels, language, source and id are never features of a score.

Edge cases: null and empty texts get the score of a text without terms; texts of
any length are read whole; a null ``doc_id`` counts as not held out and has no
label; repeated labels of an id count as toxic if any does; without learning rows
of both classes all scores are 0; repeated rows repeat their results; an empty
table gives an empty result; extra columns are ignored by :func:`score` and pass
through :func:`keep_clean`, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Interaction
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import SPACE, fresh, stage, text_or_empty

#: General insults; fixed values, a starting lexicon only.
GENERAL = (
    "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown imbecile filth vermin "
    "dummkopf arschloch abschaum wertlos connard imbecile ordure minable basura escoria inutil asqueroso"
).split()
_TOKEN = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*#@$]{2,}[^\W\d_]*")
_DRAWN = re.compile(r"([^\W\d_])\1{3}")
_COMMAND = re.compile(r"(?i)\b(?:shut up|get lost|go away|halt die klappe|verschwinde|hau ab|ta gueule|casse[- ]toi|c[aá]llate|l[aá]rgate)\b")
_REMEMBERED = 1 << 18  # words whose weights a task remembers
_EXTRA_WORDS = 10  # added to every text's length, so that a few words are no strong sign


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000
    folds: int = 4
    lexicon_terms: int = 200
    narrow_terms: int = 40
    features: int = 3000
    min_docs: int = 3
    term_rate: float = 0.004
    vote_rate: float = 0.01


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def words_of(text: str | None) -> Counter[str]:
    return Counter(_TOKEN.findall((text or "").lower()))


def terms_of(word: str) -> list[str]:
    """The word and its first 4 and 5 letters, each marked by its kind."""
    return ["w" + word, *(f"{n}{word[:n]}" for n in (4, 5) if len(word) > n)]


def rates(words: Counter[str]) -> dict[str, float]:
    """Share of a text's words that have each term."""
    counts: dict[str, int] = {}
    for word, n in words.items():
        for term in terms_of(word):
            counts[term] = counts.get(term, 0) + n
    total = words.total() + _EXTRA_WORDS
    return {term: n / total for term, n in counts.items()}


def learning_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``row, fold, toxic, weight, text`` of the bounded learning sample."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = stage(marked.where(~held_out(F.col("doc_id"))), "toxicity-labels")
    share = min(1.0, settings.max_rows / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id")
    words = F.split(F.trim(F.regexp_replace("text", SPACE + "+", " ")), " ")
    shingles = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("ws") - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("ws", i, 5), " "))
    )
    alike = F.xxhash64(F.slice(F.array_sort(F.array_distinct(shingles)), 1, 3))
    rows = rows.withColumn("ws", words).withColumn("alike", alike).drop("ws")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
    sizes = rows.groupBy("alike").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    fold = F.pmod(F.xxhash64("alike", F.lit("fold")), F.lit(settings.folds)).cast("int")  # copies are in one fold
    return stage(
        rows.join(sizes, "alike").select("row", fold.alias("fold"), F.col("toxic").cast("int").alias("toxic"), "weight", "text"), "toxicity-learn"
    )


def term_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """Weight of the texts with a term at ``term_rate`` or above, per term, fold and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [[t for t, r in rates(words_of(text)).items() if r >= settings.term_rate] for text in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.list_(pa.string()))], names=["fold", "toxic", "weight", "terms"])

    found = rows.select("fold", "toxic", "weight", "text").mapInArrow(run, "fold int, toxic int, weight double, terms array<string>")
    each = found.select("fold", "toxic", "weight", F.explode("terms").alias("term"))
    bad = F.col("weight") * F.col("toxic")
    return each.groupBy("term", "fold").agg(F.sum(bad).alias("bad"), F.sum(F.col("weight") - bad).alias("good"))


def _lift(bad: Column, good: Column, n_bad: float, n_good: float) -> Column:
    return F.log2(((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n_good + 1)))


def induced_lexicons(counts: DataFrame, sizes: dict[int, tuple[float, float]], settings: Settings) -> dict[int, dict[str, set[str]]]:
    """Per left-out fold, the terms most telling of toxic texts: a wide and a narrow lexicon of words and of each length of beginnings."""
    lists = []
    for fold in sorted(sizes):
        n_bad, n_good = (sum(n[i] for f, n in sizes.items() if f != fold) for i in (0, 1))
        told = counts.where(F.col("fold") != fold).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        told = told.where(F.col("bad") >= settings.min_docs).withColumn("lift", _lift(F.col("bad"), F.col("good"), n_bad, n_good)).where("lift > 2")
        told = stage(told.withColumn("strength", F.col("lift") * F.col("bad")), "toxicity-told")
        for kind in "w45":
            own = told.where(F.substring("term", 1, 1) == kind)
            for name, order, size in (("wide", "strength", settings.lexicon_terms), ("narrow", "lift", settings.narrow_terms)):
                best = own.orderBy(F.col(order).desc(), "term").limit(size)
                lists.append(best.select(F.lit(fold).alias("fold"), F.lit(f"{name}-{kind}").alias("lexicon"), "term"))
    out = {fold: {f"{name}-{kind}": set() for kind in "w45" for name in ("wide", "narrow")} for fold in sizes}
    for r in reduce(DataFrame.unionAll, lists).collect():
        out[r["fold"]][r["lexicon"]].add(r["term"])
    return out


def feature_terms(counts: DataFrame, n_bad: float, n_good: float, settings: Settings) -> list[str]:
    whole = counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    told = whole.where(F.col("bad") >= settings.min_docs).withColumn("lift", _lift(F.col("bad"), F.col("good"), n_bad, n_good))
    best = told.where("lift > 0").orderBy((F.col("lift") * F.col("bad")).desc(), "term").limit(settings.features)
    return [r["term"] for r in best.select("term").collect()]


def votes(text: str, words: Counter[str], found: dict[str, float], lexicons: dict[str, set[str]], rate: float) -> tuple[int, ...]:
    """1 toxic, 0 clean, -1 nothing to say; lexicons first, then the patterns."""
    out = [int(sum(found[t] for t in found.keys() & lexicon) >= rate) if words else -1 for lexicon in lexicons.values()]
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    out.append(-1 if letters < 20 else int(upper > 0.6 * letters))  # shouting
    out.append(-1 if not text else int(text.count("!") * 20 > len(text)))  # exclaiming
    out.append(int("you" in words or "du" in words or "tu" in words) if words else -1)  # addressing
    out.append(-1 if not words else int(bool(_MASKED.search(text))))  # letters of a word masked
    out.append(-1 if not words else int(bool(_DRAWN.search(text))))  # drawn-out letters
    out.append(-1 if not words else int(bool(_COMMAND.search(text))))  # sent away or silenced
    return tuple(out)


class LabelModel:
    """Votes given the class: a tree of pairwise dependencies, fitted by EM over vote patterns."""

    def __init__(self, rounds: int = 25, smooth: float = 1.0, least_gain: float = 1e-3):
        """``least_gain`` is the mutual information from which on two voters count as dependent."""
        self.rounds, self.smooth, self.least_gain = rounds, smooth, least_gain

    def fit(self, patterns: np.ndarray, counts: np.ndarray, start: list[int]) -> np.ndarray:
        """Posterior probability of class 1 per pattern. The share of toxic votes among the voters ``start`` begins the fit."""
        v = np.asarray(patterns, np.int64) + 1  # 0 nothing, 1 clean, 2 toxic
        n = np.asarray(counts, float)
        said = (v[:, start] > 0).sum(axis=1)
        share = np.where(said > 0, (v[:, start] == 2).sum(axis=1) / np.maximum(said, 1), 0.5)
        post = 0.05 + 0.9 * (share >= 0.5)
        parents = [-1] * v.shape[1]
        for round_ in range(self.rounds):
            weights = np.stack([(1 - post) * n, post * n], axis=1)
            if round_ in (3, 8):
                parents = self._tree(v, weights)
            self.prior = (weights.sum(axis=0) + self.smooth) / (weights.sum() + 2 * self.smooth)
            log_p = np.log(self.prior)[None, :].repeat(len(v), axis=0)
            self.accuracy = []
            for j, up in enumerate(parents):
                for y in (0, 1):
                    table = self._joint(v[:, j], v[:, up] if up >= 0 else np.zeros(len(v), np.int64), weights[:, y])
                    given = table / table.sum(axis=0, keepdims=True)
                    log_p[:, y] += np.log(given[v[:, j], v[:, up] if up >= 0 else 0])
                    self.accuracy.append(float(table[y + 1].sum() / max(table[1:].sum(), 1e-9)))
            top = log_p.max(axis=1, keepdims=True)
            p = np.exp(log_p - top)
            post = p[:, 1] / p.sum(axis=1)
        self.parents = parents
        return post

    def _joint(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
        table = np.full((3, 3), self.smooth / 3)
        np.add.at(table, (a, b), weight)
        return table

    def _tree(self, v: np.ndarray, weights: np.ndarray) -> list[int]:
        """Maximum spanning tree of the voters' mutual information given the class."""
        m = v.shape[1]
        gain = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                for y in (0, 1):
                    t = self._joint(v[:, i], v[:, j], weights[:, y])
                    share = t.sum() / weights.sum()
                    t = t / t.sum()
                    gain[i, j] += share * float((t * np.log(t / (t.sum(1, keepdims=True) * t.sum(0, keepdims=True)))).sum())
                gain[j, i] = gain[i, j]
        parents, inside = [-1] * m, {0}
        while len(inside) < m:
            value, child, up = max((gain[i, j], -i, j) for i in range(m) if i not in inside for j in inside)
            parents[-child] = up if value > self.least_gain else -1
            inside.add(-child)
        return parents


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    rows = learning_rows(docs, labels, settings)
    weigh = F.col("weight") * F.col("toxic")
    sizes = {r["fold"]: (r["bad"], r["good"]) for r in rows.groupBy("fold").agg(F.sum(weigh).alias("bad"), F.sum(F.col("weight") - weigh).alias("good")).collect()}
    n_bad, n_good = sum(b for b, _ in sizes.values()), sum(g for _, g in sizes.values())
    if n_bad < 1e-9 or n_good < 1e-9:
        return Model({}, -50.0)
    counts = stage(term_counts(rows, settings), "toxicity-terms")
    general = {"general": {"w" + w for w in GENERAL}}
    lexicons = {fold: general | own for fold, own in induced_lexicons(counts, sizes, settings).items()}
    names = feature_terms(counts, n_bad, n_good, settings)
    known_terms = frozenset(names)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                said, held, scale = [], [], []
                for fold, label, text in zip(*(part.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                    words = words_of(text)
                    said.append(",".join(map(str, (label, *votes(text, words, rates(words), lexicons[fold], settings.vote_rate)))))
                    held.append([t for w, n in words.items() for t in terms_of(w) if t in known_terms for _ in range(n)])
                    scale.append(100 / (words.total() + _EXTRA_WORDS))
                columns = [part.column(0), part.column(3), pa.array(said), pa.array(held, pa.list_(pa.string())), pa.array(scale)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "weight", "votes", "terms", "scale"])

    source = rows.select("row", "fold", "toxic", "weight", "text")
    voted = stage(source.mapInArrow(vote, "row long, weight double, votes string, terms array<string>, scale double"), "toxicity-votes")
    patterns = voted.groupBy("votes").agg(F.sum("weight").alias("n")).collect()  # at most one per learning row
    table = np.array([[int(x) for x in r["votes"].split(",")] for r in patterns])
    posterior = LabelModel().fit(table, np.array([r["n"] for r in patterns]), start=list(range(1, 8)))  # the lexicons
    known = rows.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(patterns, posterior, strict=True)], "votes string, p double")
    soft = voted.join(F.broadcast(known), "votes")  # bounded by the learning rows
    if not names:
        return Model({}, -50.0)
    counted = CountVectorizerModel.from_vocabulary(names, "terms", "counts").transform(soft)
    data = Interaction(inputCols=["scale", "counts"], outputCol="features").transform(counted)
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w"))))
    data = data.select("features", "weight", both.alias("s")).select("features", "s.label", (F.col("s.w") * F.col("weight")).alias("w")).where("w > 1e-6")
    fitted = LogisticRegression(weightCol="w", regParam=1e-4, maxIter=60, standardization=False).fit(data)
    values = fitted.coefficients.toArray()
    return Model({t: float(values[i]) for i, t in enumerate(names) if values[i]}, float(fitted.intercept))


def score_texts(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` and, under ``name``, the score of every whole text."""
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            if len(known) >= _REMEMBERED:
                known.clear()
            total = known[word] = sum(weights.get(t, 0.0) for t in terms_of(word))
            return total

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text in part.column(part.num_columns - 1).to_pylist():
                    words = words_of(text)
                    x = sum([n * (known[w] if w in known else weight(w)) for w, n in words.items()])
                    x = bias + 100 * x / (words.total() + _EXTRA_WORDS)
                    out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, x)))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.float64())], names=[*columns, name])

    source = docs.select(*columns, F.col("text").alias(fresh("text", columns)))
    return source.mapInArrow(run, docs.select(*columns).schema.add(name, "double"))


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = train(docs, labels, settings)
    return score_texts(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = train(docs, labels, settings)
    name = fresh("score", docs.columns)
    return score_texts(docs, model, docs.columns, name).where(F.col(name) < 0.5).drop(name)
