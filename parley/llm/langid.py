"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords (2 to 4 code points of a lower-cased word with its borders) are hashed to buckets, each with an
embedding; their mean goes through a linear softmax. Both are trained together by stochastic gradient descent in
numpy, on a bounded sample. What is broadcast are both: the embeddings, of fixed size, and a short row for each language.
Confidence is calibrated on rows held back from training: a temperature, and the threshold under which a
prediction counts as rejected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import bound_batches
from .common import bounded_sample

UNKNOWN = "und"
#: Hash buckets (a power of two), embedding size, and the subwords' lengths.
BITS, DIM, LENGTHS = 16, 16, (2, 3, 4)
#: At most so many rows train the model (one of each language at least), and so many of one language.
SAMPLE_ROWS, CLASS_ROWS = 6000, 1200
#: Code points that are hashed at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    vectors: np.ndarray  # a bucket's embedding
    weights: np.ndarray  # a language's row of the softmax
    temperature: float
    threshold: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's subwords, in chunks; nothing for a text without letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    longest = LENGTHS[-1]
    for lo in range(0, len(codes), CHUNK):
        # a chunk holds the subwords that begin in it
        part = codes[lo : lo + CHUNK + longest - 1]
        part = np.where(_letters()[part], part, 32).astype(np.uint32)
        border = part == 32
        if border.all():
            continue
        h, inner = part.copy(), np.zeros(len(part), bool)
        for n in range(2, longest + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) ^ part[n - 1 :] * np.uint32(0x85EBCA6B)
            if n > 2:
                inner = inner[:m] | border[n - 2 : n - 2 + m]
            if n in LENGTHS:
                keep = ~(inner[:m] | (border[:m] & border[n - 1 :]))
                keep[CHUNK:] = False
                yield ((h[keep] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, buckets, counts) of each text that has letters."""
    for batch in batches:
        langs, buckets, counts = [], [], []
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if parts := list(_subwords(text or "")):
                at, n = np.unique(np.concatenate(parts), return_counts=True)
                langs.append(lang)
                buckets.append(at.astype(np.int32))
                counts.append(n.astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["lang", "buckets", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit(rows: list[tuple[int, np.ndarray, np.ndarray]], langs: tuple[str, ...], epochs: int, rate: float, seed: int) -> LanguageModel:
    """rows: (language, buckets, counts); every tenth is held back for calibration."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights = np.zeros((len(langs), DIM), np.float32)
    rows = [(y, at, (n / n.sum())[:, None]) for y, at, n in rows]
    held, kept = rows[::10], [r for i, r in enumerate(rows) if i % 10] or rows
    steps, total = 0, epochs * len(kept)
    for _ in range(epochs):
        for i in rng.permutation(len(kept)):
            y, at, share = kept[i]
            step = rate * (1 - steps / total)
            steps += 1
            v = (share * vectors[at]).sum(axis=0)
            g = _softmax(weights @ v)
            g[y] -= 1
            back = weights.T @ g
            weights -= step * np.outer(g, v)
            vectors[at] -= step * len(at) ** 0.5 * share * back
    z = np.array([(share * vectors[at]).sum(axis=0) for _, at, share in held]) @ weights.T
    y = np.array([r[0] for r in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y
    # the lowest confidence from which on at least 99 of 100 are right
    order = np.argsort(-sure, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99)
    return LanguageModel(langs, vectors, weights, temperature, float(sure[order[good[-1]]]) if len(good) else 1.0)


def train_language_model(docs: DataFrame, epochs: int = 5, rate: float = 1.0, seed: int = 17) -> LanguageModel | None:
    """A model from the rows with a language; ``None`` if there are none.

    At most SAMPLE_ROWS of them train it, an equal share for each language (one row at least, so there may be more rows
    if there are more languages): those with the smallest hashes. All languages are learned. Of several texts or languages of an id, one is used; rows
    without an id teach nothing. One task fits the sample; only the model comes to the driver.
    """
    bound_batches(docs.sparkSession)
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", lang.alias("lang"), text.alias("text"))
    langs = tuple(sorted(r["lang"] for r in known.select("lang").distinct().collect()))  # names of languages, not rows
    if not langs:
        return None
    ids = bounded_sample(known.select("doc_id", "lang"), "lang", max(1, min(CLASS_ROWS, SAMPLE_ROWS // len(langs))), seed)
    chosen = known.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.struct("lang", F.xxhash64("text"), "text")).alias("row"))
    counts = chosen.select("row.lang", "row.text").mapInArrow(_counts, "lang string, buckets array<int>, counts array<float>")
    sample = counts.repartition(1).sortWithinPartitions(F.xxhash64("lang", F.hash("buckets")), "lang")
    found = sample.mapInArrow(lambda it: _fit_batches(it, langs, epochs, rate, seed), "model binary").first()
    return pickle.loads(found["model"]) if found else None


def _fit_batches(batches: Iterator[pa.RecordBatch], langs: tuple[str, ...], epochs: int, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    number, rows = {x: i for i, x in enumerate(langs)}, []
    for batch in batches:
        rows += [(number[a], np.array(b.values), np.array(c.values)) for a, b, c in zip(batch["lang"].to_pylist(), batch["buckets"], batch["counts"], strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fit(rows, langs, epochs, rate, seed))], pa.binary())], ["model"])


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores, rejected = [], [], []
        for text in batch["text"]:
            sums, n = np.zeros(DIM), 0
            for at in _subwords(text.as_py() or "") if model else ():
                sums, n = sums + model.vectors[at].sum(axis=0, dtype=np.float64), n + len(at)
            if n:
                p = _softmax(model.weights @ (sums / n) / model.temperature)
                best = int(p.argmax())
                langs.append(model.langs[best])
                scores.append(float(p[best]))
                rejected.append(bool(p[best] < model.threshold))
            else:
                langs.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(True)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])


def identify_language(spark: SparkSession, docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row's whole text.

    Null texts and texts without a letter are ``und`` with score 0; so is every text if ``model`` is None. A
    prediction under the model's threshold is rejected: it stays in ``lang_pred``, as the likeliest. Repeated rows
    get equal results; other columns are ignored. Nothing is shuffled; the model's size is fixed.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, shared.value), "doc_id long, lang_pred string, score double, rejected boolean")

