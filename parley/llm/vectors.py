"""What both vector searches share: which vectors take part, and how rows become matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(embedding: Column) -> Column:
    """True for a vector that is not null or empty and holds no null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad, F.lit(False))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, embedding as doubles) of the vectors that take part, and their dimension (0 if there are none).

    Without ``dim`` the most frequent one holds (of equally frequent ones, the smallest); rows of another
    dimension, with a null id or that aren't ``finite`` take no part. Of rows that share an id, all do.
    """
    e = F.col(embedding).cast("array<double>")
    rows = vectors.where(F.col(vec_id).isNotNull() & finite(e)).select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("embedding"))
    if dim is None:
        most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = most["d"] if most else 0
    return rows.where(F.size("embedding") == dim), dim


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as doubles, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def top(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates sorted in any way, the ``k`` best places of each query: larger scores first, then smaller ids;
    with the ranks from 1."""
    order = np.lexsort((vec_id, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) + 1
    return order[rank <= k], rank[rank <= k]
