"""Whitening of embeddings by exact integer covariances.

Entries are scaled to whole numbers. A matrix product of floating point numbers is exact as long as every sum stays
under 2**53, so the integers are cut into limbs of LIMB bits and at most ROWS rows are multiplied at once: BLAS does the
work, and nothing is rounded. Limb products of equal weight are added as 64-bit integers with carries, tasks' sums
are merged by Spark row by row, and only there the limbs become big integers. What comes to the driver is one row of
doubles for each dimension, whose eigenvectors it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import bound_batches
from .common import Scratch
from .vectors import finite

#: 2 * LIMB bits a product, ROWS of them in a sum: 2**52 at most.
LIMB, ROWS = 20, 4096
SUMS = "row int, cells binary"
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Sums of ``n`` distinct vectors; for each component its direction over the root of its variance (None if it has none)."""

    n: int
    sums: tuple[int, ...]
    axes: tuple[np.ndarray | None, ...]
    explained: tuple[float, ...]
    identity_error: float = 0.0


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Digits of whole numbers (64-bit or unbounded) to base 2**LIMB, as doubles; the last one has the sign."""
    most = max(int(y.max()), -int(y.min())) if y.size else 0
    out = []
    for _ in range(max(1, -(-most.bit_length() // LIMB)) - 1):
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


class _Places:
    """Exact sums by weight: place p counts 2**(LIMB * p), and all but the last are under 2**LIMB once carried."""

    def __init__(self) -> None:
        self.sums: list[np.ndarray] = []

    def add(self, place: int, value: np.ndarray) -> None:
        while len(self.sums) <= place:
            self.sums.append(np.zeros(value.shape, np.int64))
        self.sums[place] += value.astype(np.int64)

    def carry(self) -> None:
        p = 0
        while p < len(self.sums):
            over = self.sums[p] >> LIMB
            if p + 1 == len(self.sums):
                if not (np.abs(self.sums[p]) >> LIMB).any():
                    break
                self.sums.append(np.zeros_like(over))
            self.sums[p] -= over << LIMB
            self.sums[p + 1] += over
            p += 1

    def gram(self, y: np.ndarray) -> None:
        """Adds y.T @ y, exactly, for at most ROWS rows."""
        parts = limbs(y)
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                product = a.T @ parts[j]
                self.add(i + j, product if i == j else product + product.T)
        self.carry()


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, in 64 bits if all of it fits, else unbounded."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _integers(batch["x"], dim)
        for at in range(0, len(x), ROWS):
            yield x[at : at + ROWS]


def _rows(cells: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    rows = list(cells)
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([c.tobytes() for _, c in rows], pa.binary())], ["row", "cells"])


def _sum(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """One task's sum of its vectors, as row 0."""
    total = _Places()
    for x in _chunks(batches, dim):
        for p, a in enumerate(limbs(x)):
            total.add(p, a.sum(axis=0))
        total.carry()
    if total.sums:
        yield _rows([(0, np.array(total.sums))])


def _products(batches: Iterator[pa.RecordBatch], dim: int, n: int, sums: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """One task's sum of the outer products of its centred vectors, a row for each dimension."""
    total = _Places()
    for x in _chunks(batches, dim):
        total.gram(_centred(x, n, sums))
    if total.sums:
        places = np.array(total.sums)
        for at in range(0, dim, 64):
            yield _rows((i, np.ascontiguousarray(places[:, i])) for i in range(at, min(at + 64, dim)))


def _merged(batches: Iterator[pa.RecordBatch], dim: int, divisor: int) -> Iterator[pa.RecordBatch]:
    """(row, values): the tasks' sums of each row, as big integers over ``divisor``, rounded once; and as text."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, cells in zip(batch["row"].to_pylist(), batch["cells"].to_pylist(), strict=True):
            new = np.frombuffer(cells, np.int64).reshape(-1, dim)
            old = found.get(row)
            if old is None:
                found[row] = new.copy()
            else:
                if len(new) > len(old):
                    old, new = new.copy(), old
                old[: len(new)] += new
                found[row] = old
    for row, places in found.items():
        whole = [sum(int(v) << (LIMB * p) for p, v in enumerate(column)) for column in places.T]
        values = pa.array([[v / divisor for v in whole]], pa.list_(pa.float64()))
        exact = pa.array([[str(v) for v in whole] if not row else None], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), values, exact], ["row", "values", "exact"])


def _errors(batches: Iterator[pa.RecordBatch], dim: int, model: Whitening) -> Iterator[pa.RecordBatch]:
    """One task's sums of the products of whitened components."""
    axes = [a for a in model.axes if a is not None]
    total = np.zeros((len(axes), len(axes)))
    for x in _chunks(batches, dim):
        w = (_centred(x, model.n, model.sums).astype(np.float64) / model.n) @ np.array(axes).T
        total += w.T @ w
    a, b = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(a.ravel().astype(np.int32)), pa.array(b.ravel().astype(np.int32)), pa.array(total.ravel())], ["a", "b", "value"])


def _whiten(batches: Iterator[pa.RecordBatch], dim: int, model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.axes)
    for batch in batches:
        x = _integers(batch["x"], dim)
        y = _centred(x, model.n, model.sums)
        most = max(int(y.max()), -int(y.min())) if y.size else 0
        if dim * most * most < 1 << 63:
            deviation = pa.array((y * y).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
        else:
            exact = (y.astype(object) ** 2).sum(axis=1).tolist()
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
        centred = y.astype(np.float64) / model.n
        whitened = np.array([centred @ a if a is not None else np.full(len(x), np.nan) for a in model.axes]).T.reshape(-1)
        rows = np.repeat(np.arange(len(x)), k)
        columns = [
            batch["vec_id"].take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), model.n)), deviation.take(pa.array(rows)),
            pa.array(whitened, mask=np.tile(np.array([a is None for a in model.axes]), len(x))), pa.array(np.tile(np.array(model.explained), len(x))), pa.array(np.full(len(rows), model.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])


def scaled(vectors: DataFrame, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that take part, with x = floor(scale * entry); and their dimension (0: there are none).

    The most frequent dimension holds (of equally frequent ones, the smallest).
    """
    e = F.col(embedding).cast("array<double>")
    inside = F.forall(e, lambda c: F.abs(c * scale) < 2.0**63)
    rows = vectors.where(finite(e) & inside).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda c: F.floor(c * scale)).alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 0
    return rows.where(F.size("x") == dim), dim


def fit_whitening(spark: SparkSession, fit: DataFrame, dim: int, components: int) -> Whitening:
    """The model of the vectors in ``fit`` (x), each of which counts once.

    Eigenvectors are those of the covariance of x about its mean, divisor n. A component whose variance is nil (up to
    rounding) has no axis. The identity error is measured over ``fit``.
    """
    n = fit.count()
    merged = "row int, values array<double>, exact array<string>"
    total = fit.mapInArrow(lambda it: _sum(it, dim), SUMS).repartition(1).mapInArrow(lambda it: _merged(it, dim, 1), merged).first()
    sums = tuple(map(int, total["exact"]))
    parts = fit.mapInArrow(lambda it: _products(it, dim, n, sums), SUMS).repartition("row")
    covariance = np.zeros((dim, dim))
    for r in parts.mapInArrow(lambda it: _merged(it, dim, n**3), merged).select("row", "values").toLocalIterator():
        covariance[r["row"]] = r["values"]
    size = float(np.abs(covariance).max())
    e, v = np.linalg.eigh(covariance / size if size else covariance)
    best = np.argsort(-e, kind="stable")[:components]
    nil = dim * np.finfo(float).eps * max(float(e.max()), 0.0)
    axes = tuple(v[:, i] / np.sqrt(e[i]) / np.sqrt(size) if e[i] > nil else None for i in best)
    trace = float(np.trace(covariance / size)) if size else 0.0
    model = Whitening(n, sums, axes, tuple(float(e[i]) / trace if e[i] > nil else 0.0 for i in best))
    held = [a for a in axes if a is not None]
    if not held:
        return model
    rows = fit.mapInArrow(lambda it: _errors(it, dim, model), "a int, b int, value double").groupBy("a", "b").agg(F.sum("value").alias("value")).collect()
    error = max(abs(r["value"] / n - (r["a"] == r["b"])) for r in rows)
    return Whitening(n, sums, axes, model.explained, error)


def whiten(spark: SparkSession, vectors: DataFrame, components: int = 4, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(OUT): each vector's first ``components`` whitened components (all, if the dimension is smaller).

    Vectors that are null or empty, that hold a null or non-finite entry or one that scaled is beyond 64 bits, and those
    of another dimension take no part. Rows that share an id, or have none, each have their rows. Equal vectors
    count once in the model. A component without variance has a null ``whitened`` and explains 0.0. ``deviation``
    is null beyond 38 digits. Without vectors there are no rows. Other columns don't matter, whatever their names.
    """
    bound_batches(spark)
    rows, dim = scaled(vectors, scale, vec_id, embedding)
    if not dim:
        return spark.createDataFrame([], OUT)
    scratch = Scratch(spark)
    model = fit_whitening(spark, scratch.save(rows.select("x").distinct(), "fit"), dim, components)
    scratch.drop("fit")
    return rows.mapInArrow(lambda it: _whiten(it, dim, model), OUT)
