"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words' features (the word and
its beginnings); a document's is the noisy-or of its sentences' scores. Only documents have labels: the
gradient of the noisy-or deals a document's label out to its sentences. The sentences that score high are then
where the document offends.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.shared import bound_batches
from .common import Scratch, bounded_sample

#: Lengths of the word beginnings that are features. Every feature starts with some HEAD code points.
PREFIXES, HEAD = (3, 4, 5, 6, 7), 3
#: At most so many toxic and so many other documents train the model.
TOXIC_ROWS, OTHER_ROWS = 1500, 3000
#: A feature needs so many documents of the sample, and so much chi-square, to be learned.
LEAST_DOCS, LEAST_CHI2 = 4, 8.0

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, float]
    beginnings: dict[str, float]
    bias: float
    #: log-odds of a document = slope * log-odds of the noisy-or + shift
    slope: float = 1.0
    shift: float = 0.0
    #: the score of every text if there is nothing to learn from
    prior: float | None = None


def _features(word: str) -> list[tuple[bool, str]]:
    """Whether it is a beginning, and its text."""
    return [(False, word), *((True, word[:n]) for n in PREFIXES if len(word) >= n)]


def _words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


class _Weigher:
    """The weight of a sentence: the sum over its distinct words of their features'. Few words begin like a learned
    feature; the others cost one look-up."""

    def __init__(self, model: ToxicityModel):
        self.model, self.heads = model, frozenset(f[:HEAD] for f in (*model.words, *model.beginnings))

    def word(self, word: str) -> float:
        return self.model.words.get(word, 0.0) + sum(self.model.beginnings.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n)

    def __call__(self, sentence: str) -> float:
        heads = self.heads
        found = {w for w in _WORD.findall(sentence.lower()) if w[:HEAD] in heads}
        return sum(map(self.word, sorted(found))) if found else 0.0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, words, ends): distinct words of all sentences in a row, and where each sentence ends."""
    for batch in batches:
        words, ends = [], []
        for text in batch["text"].to_pylist():
            at, end = [], []
            for m in _SENTENCE.finditer(text or ""):
                at += sorted(_words(m[0]))
                end.append(len(at))
            words.append(at)
            ends.append(end)
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(words, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], ["toxic", "words", "ends"])


def _log_or(z: np.ndarray) -> float:
    """Log-odds of the noisy-or of sentences with log-odds ``z``."""
    none = -np.logaddexp(0, z).sum()  # log of the probability that no sentence offends
    return float(math.log(max(-math.expm1(none), 1e-300)) - none)


def _fit(rows: pa.Table, share: float, epochs: int, rate: float, seed: int) -> ToxicityModel:
    """rows: (toxic, words, ends); share: of toxic documents among all labelled. Every fifth row calibrates."""
    rng = np.random.default_rng(seed)
    labels, lists, stops = np.asarray(rows["toxic"]), rows["words"].combine_chunks(), rows["ends"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    word_of, begins = np.asarray(coded.indices), np.asarray(lists.offsets)
    number: dict[tuple[bool, str], int] = {}
    of_word = [[number.setdefault(f, len(number)) for f in _features(w)] for w in coded.dictionary.to_pylist()]
    starts = np.cumsum([0, *map(len, of_word)])
    flat = np.array([f for fs in of_word for f in fs], np.int64)
    totals = np.array([(labels == y).sum() for y in (0, 1)], float)

    def bag(i: int) -> tuple[np.ndarray, np.ndarray, int]:
        """A row's features, the sentence of each, and its number of sentences."""
        words, ends = word_of[begins[i] : begins[i + 1]], np.asarray(stops[i].values)
        n = starts[words + 1] - starts[words]
        features = flat[np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return features, np.repeat(np.searchsorted(ends, np.arange(len(words)), side="right"), n), len(ends)

    by_class = np.zeros((2, len(number)), np.int64)
    for i, y in enumerate(labels.tolist()):
        by_class[y, np.unique(bag(i)[0])] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        n = by_class.sum(axis=0)
        expected = n * totals[1] / totals.sum()
        variance = n * (totals[1] / totals.sum()) * (totals[0] / totals.sum()) * (1 - n / totals.sum())
        learned = (n >= LEAST_DOCS) & ((by_class[1] - expected) ** 2 / variance >= LEAST_CHI2)
    bags = [(y, at[learned[at]], sentence[learned[at]], m) for y, (at, sentence, m) in zip(labels.tolist(), map(bag, range(len(labels))), strict=True)]
    size = len(number)
    held, kept = bags[::5], [b for i, b in enumerate(bags) if i % 5] or bags
    weights, squares, bias, bias_square = np.zeros(size), np.full(size, 1e-3), -4.0, 1e-3
    balance = totals.sum() / (2 * np.maximum(totals, 1))
    for _ in range(epochs):
        for i in rng.permutation(len(kept)):
            y, at, sentence, m = kept[i]
            if not m:
                continue
            z = bias + np.bincount(sentence, weights[at], m)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            if y:
                any_ = -math.expm1(-np.logaddexp(0, z).sum())
                back = -(1 - any_) / max(any_, 1e-9) * p
            else:
                back = p
            back = back * balance[y]
            g = back.sum()
            bias_square += g * g
            bias -= rate * g / math.sqrt(bias_square)
            if len(at):
                at_, inverse = np.unique(at, return_inverse=True)
                g = np.bincount(inverse, back[sentence]) + 1e-4 * weights[at_]
                squares[at_] += g * g
                weights[at_] -= rate * g / np.sqrt(squares[at_])
    # calibration: a logistic of the log-odds, with the classes' shares as among all labelled rows
    x = np.array([_log_or(bias + np.bincount(s, weights[a], m)) if m else -30.0 for _, a, s, m in held])
    y = np.array([b[0] for b in held], float)
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    x = np.clip(x, -30, 30)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Newton's method, damped
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        g = np.array([(w * (p - y) * x).sum(), (w * (p - y)).sum()]) + np.array([1e-2 * (slope - 1), 1e-3 * shift])
        q = w * p * (1 - p)
        h = np.array([[(q * x * x).sum() + 1e-2, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        slope, shift = float(np.clip(slope - 0.5 * step[0], 0.05, 5)), float(shift - 0.5 * step[1])
    kept_ = [(f, float(weights[i])) for f, i in number.items() if learned[i] and weights[i]]
    return ToxicityModel({t: w for (b, t), w in kept_ if not b}, {t: w for (b, t), w in kept_ if b}, float(bias), slope, shift)


def train_toxicity(docs: DataFrame, labels: DataFrame, epochs: int = 8, rate: float = 0.2, seed: int = 17) -> ToxicityModel:
    """A model from the documents that ``labels`` (doc_id, toxic) marks.

    At most TOXIC_ROWS toxic and OTHER_ROWS other documents train it: those with the smallest hashes. Labels of a
    repeated id count as toxic if one does, and one of its texts is used; null ids and labels are left out. If one class is missing, the model
    gives every text the other's label as its score (0 without any label).
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = scratch.save(marked.join(docs.select("doc_id").where("text is not null").distinct(), "doc_id", "left_semi"), "known")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return ToxicityModel({}, {}, 0.0, prior=float(next(iter(counts), 0)))
    few = bounded_sample(known, "toxic", max(TOXIC_ROWS, OTHER_ROWS), seed).withColumn("r", F.xxhash64("doc_id", F.lit(seed)))
    ids = few.where("toxic = 1").orderBy("r").limit(TOXIC_ROWS).unionByName(few.where("toxic = 0").orderBy("r").limit(OTHER_ROWS)).select("doc_id", "toxic")
    text = F.col("text").cast("string")
    # of several texts of an id, the one with the smallest hash
    chosen = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
    bags = chosen.select("toxic", "text").mapInArrow(_bags, "toxic int, words array<string>, ends array<int>")
    share = counts[1] / (counts[0] + counts[1])
    # the sample is of bounded size, so one task fits it; only the model comes to the driver
    sample = bags.repartition(1).sortWithinPartitions(F.xxhash64("words", F.lit(seed)), "toxic")
    model = pickle.loads(sample.mapInArrow(lambda it: _fit_batches(it, share, epochs, rate, seed), "model binary").first()["model"])
    scratch.drop("known")
    return model


def _fit_batches(batches: Iterator[pa.RecordBatch], share: float, epochs: int, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    model = _fit(pa.Table.from_batches(batches), share, epochs, rate, seed)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def _judge(text: str | None, model: ToxicityModel, weight: _Weigher, least: float) -> tuple[float, list[dict]]:
    """A text's score, and its sentences that score ``least`` or more."""
    if model.prior is not None:
        return model.prior, []
    none, spots = 0.0, []
    for m in _SENTENCE.finditer(text or ""):
        z = model.bias + weight(m[0])
        none -= z if z > 30 else math.log1p(math.exp(z))
        if z > 0 and (p := 1 / (1 + math.exp(-min(z, 40.0)))) >= least:
            spots.append({"start": m.start(), "end": m.end(), "score": p})
    odds = max(-30.0, min(30.0, math.log(max(-math.expm1(none), 1e-300)) - none))
    return 1 / (1 + math.exp(-(model.slope * odds + model.shift))), spots


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel, least: float) -> Iterator[pa.RecordBatch]:
    weight = _Weigher(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        judged = [_judge(text.as_py(), model, weight, least) for text in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([j[0] for j in judged], pa.float64()), pa.array([j[1] for j in judged], kind)], ["doc_id", "score", "offending"])


def toxic_score(spark: SparkSession, text: Column, model: ToxicityModel) -> Column:
    """The score of a text column, for rows that keep all their other columns."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = _Weigher(shared.value)
        for texts in batches:
            yield texts.map(lambda t: _judge(t, shared.value, weight, 1.0)[0]).astype("float64")

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_toxicity(spark: SparkSession, docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """(doc_id, score, offending) of every row's whole text; ``offending`` has the sentences that score ``least``
    or more, as code point ranges.

    Null and empty texts have no sentence and get the lowest score. Repeated rows get equal results; other columns
    are ignored. Nothing is shuffled; the model's size is fixed.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, shared.value, least), "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")
