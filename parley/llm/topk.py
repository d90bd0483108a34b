"""Exact top-k inner products by block-at-a-time pruning.

Vectors are ordered by a locality key and dealt into groups, and a group into blocks of BLOCK rows. A block keeps
its rows as a forward index (a matrix of integers) and each dimension's largest and smallest value. A query's bound
for a block is the sum over its terms (dimensions) of the largest product a row there can have. A query visits a
group's blocks in descending order of the bounds and scores whole blocks, until the bounds fall below its k-th
best score.

A first pass scores each query in the group it lies in, which gives it a k-th score to start with. Then queries
meet one row of maxima and minima for each group, in chunks of groups: only the pairs of a query and a group whose
bound reaches that score go on, so what is shuffled grows with the pairs that survive. A group meets its queries
in batches of bounded size, one task's unit each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small
from .vectors import matrix, top, usable

#: Rows of a block, of a group, and groups whose maxima are looked at together.
BLOCK, GROUP, CHUNK = 128, 8192, 1024
#: Bytes of the terms of a batch of queries (16,384 queries of 64 dimensions), and of queries that may be broadcast.
BATCH_BYTES, BROADCAST_BYTES = 8 << 20, 16 << 20
#: Hits that a search holds before it drops those that aren't among the best.
HELD = 1 << 20
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
RESULT = "query_id long, rank int, vec_id long, score long"


def _planes(dim: int, n: int = 16) -> list[list[float]]:
    return np.random.default_rng(17).standard_normal((n, dim)).round(6).tolist()


def _pack(batches: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a partition as groups: (ids, rows, most, least), little-endian int64 and float64."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []

    def groups() -> pa.RecordBatch:
        a, b = np.concatenate(ids), np.concatenate(rows)
        parts = [(a[lo : lo + GROUP], b[lo : lo + GROUP]) for lo in range(0, len(a), GROUP)]
        out = [(x.tobytes(), y.tobytes(), y.max(axis=0).tobytes(), y.min(axis=0).tobytes()) for x, y in parts]
        ids.clear()
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(4)], ["ids", "rows", "most", "least"])

    largest = np.finfo(np.float64).max
    for batch in batches:
        if batch.num_rows:
            ids.append(np.asarray(batch["vec_id"], "<i8"))
            with np.errstate(over="ignore"):
                rows.append(np.clip(np.floor(scale * matrix(batch["embedding"], dim)), -largest, largest).astype("<f8"))
            if sum(map(len, ids)) >= GROUP:
                yield groups()
    if ids:
        yield groups()


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of integers that are held as doubles. Through doubles where those can't round, through 64-bit
    integers where those can't overflow, else, for the rows that are too large, through unbounded ones; results
    beyond 64 bits are the nearest."""
    large_a, large_b = (np.abs(x).max(axis=1, initial=0.0) for x in (a, b))
    with np.errstate(over="ignore"):
        most = large_a.max(initial=0.0) * large_b.max(initial=0.0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    fits_a, fits_b = (large < (2.0**62 / a.shape[1]) ** 0.5 for large in (large_a, large_b))
    out = np.empty((len(a), len(b)), np.int64)
    out[np.ix_(fits_a, fits_b)] = a[fits_a].astype(np.int64) @ b[fits_b].astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    for rows, columns in ((~fits_a, np.ones(len(b), bool)), (fits_a, ~fits_b)):
        if rows.any() and columns.any():
            out[np.ix_(rows, columns)] = np.clip(whole(a[rows]) @ whole(b[columns]).T, -_HIGH, _HIGH).astype(np.int64)
    return out


def _both_signs(terms: np.ndarray) -> np.ndarray:
    """Terms to be multiplied with maxima, then those to be multiplied with minima."""
    return np.concatenate([np.maximum(terms, 0), np.minimum(terms, 0)], axis=1)


def _rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _seed(batches: Iterator[pa.RecordBatch], dim: int, k: int, every: int) -> Iterator[pa.RecordBatch]:
    """The queries of each group, with the k-th best score that the group has for them."""
    for batch in batches:
        for ids, rows in zip(batch["ids"], batch["rows"], strict=True):
            a, b = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(rows.as_py(), "<f8").reshape(-1, dim)
            at = np.flatnonzero(a % every == 0)
            for lo in range(0, len(at), 512):
                part = at[lo : lo + 512]
                scores = _exact(b[part], b)
                scores[a[part][:, None] == a[None, :]] = _LOW
                kth = np.partition(scores, len(a) - k, axis=1)[:, len(a) - k] if len(a) > k else np.full(len(part), _LOW)
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array([x.tobytes() for x in b[part]], pa.binary()), pa.array(kth)], ["query_id", "terms", "floor"])


def _reach(queries: pa.Table, bounds: pa.Table, dim: int) -> pa.Table:
    """(gid, queries): which queries of a batch may find one of their k best in each group of a chunk."""
    gids, found = [], []
    if queries.num_rows and bounds.num_rows:
        number, terms, floor = np.asarray(queries["query"], np.int64), _both_signs(_rows(queries["terms"], dim)), np.asarray(queries["floor"], np.int64)
        ends = np.concatenate([_rows(bounds["most"], dim), _rows(bounds["least"], dim)], axis=1)
        for lo in range(0, len(ends), 64):
            for gid, bound in zip(bounds["gid"].slice(lo, 64).to_pylist(), _exact(ends[lo : lo + 64], terms), strict=True):
                if len(reached := number[bound >= floor]):
                    gids.append(gid)
                    found.append(reached)
    return pa.table({"gid": pa.array(gids, pa.int64()), "queries": pa.array(found, pa.list_(pa.int64()))})


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best hits of each query."""
    q, c, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    at, _ = top(q, s, c, k)
    return q[at], c[at], s[at]


def _search(queries: pa.Table, groups: pa.Table, dim: int, k: int) -> pa.Table:
    """One batch of queries against one group."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    number, q_ids = (np.asarray(queries[c], np.int64) for c in ("query", "query_id"))
    terms, floor = _rows(queries["terms"], dim), np.asarray(queries["floor"], np.int64).copy()
    for ids, rows in zip(groups["ids"], groups["rows"], strict=True) if len(q_ids) else ():
        a, b = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(rows.as_py(), "<f8").reshape(-1, dim)
        starts = np.arange(0, len(a), BLOCK)
        ends = np.concatenate([np.maximum.reduceat(b, starts), np.minimum.reduceat(b, starts)], axis=1)
        bounds = _exact(_both_signs(terms), ends)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = np.full((len(q_ids), k), _LOW)  # the k best scores so far
        for step in range(len(starts)):
            nth = order[:, step]
            open_ = np.flatnonzero(bounds[np.arange(len(q_ids)), nth] >= floor)
            if not len(open_):
                break
            for block in np.unique(nth[open_]):
                who, ids_ = open_[nth[open_] == block], a[starts[block] : starts[block] + BLOCK]
                scores = _exact(terms[who], b[starts[block] : starts[block] + BLOCK])
                scores[q_ids[who][:, None] == ids_[None, :]] = _LOW
                best[who] = np.partition(np.concatenate([best[who], scores], axis=1), len(ids_), axis=1)[:, len(ids_) :]
                floor[who] = np.maximum(floor[who], best[who].min(axis=1))
                q, c = np.nonzero((scores >= floor[who][:, None]) & (scores > _LOW))
                at, _ = top(q, scores[q, c], ids_[c], k)
                found.append((who[q[at]], ids_[c[at]], scores[q[at], c[at]]))
                held += len(at)
                if held > HELD:
                    found = [_best(found, k)]
                    held = len(found[0][0]) // 2  # what is best stays, so the next time comes later
    q, c, s = _best(found, k)
    return pa.table({"query": number[q], "query_id": q_ids[q], "vec_id": c, "score": s})


def exact_top_k(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k`` other rows with
    the largest inner products of ``floor(scale * x)``; of equal scores, smaller ids first.

    Null and empty vectors, those with null or non-finite components, with another dimension than most, or with a
    null id take no part. Rows that share an id are not candidates of one another; each is a candidate of others,
    and each is a query with a list of its own. A product of ``scale`` and a component beyond the range of doubles is
    the largest double; a score beyond 64 bits is the nearest that fits, and such scores tie. With fewer than ``k``
    others, all are returned. An empty table gives no rows; other columns are ignored.
    """
    rows, dim = usable(vectors)
    scratch = Scratch(spark)
    if not dim:
        return spark.createDataFrame([], RESULT)
    n = rows.count()
    keyed = rows.select("vec_id", "embedding")
    bits = [F.when(F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, p)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) > 0, 1 << i).otherwise(0) for i, p in enumerate(_planes(dim))]
    keyed = keyed.withColumn("near", sum(bits[1:], bits[0]))
    dealt = keyed.repartitionByRange(max(1, -(-n // GROUP)), "near", "vec_id").sortWithinPartitions("near", "vec_id")
    packed = dealt.select("vec_id", "embedding").mapInArrow(lambda it: _pack(it, dim, scale), "ids binary, rows binary, most binary, least binary")
    groups = scratch.save(packed.withColumn("gid", F.monotonically_increasing_id()), "groups")
    seeded = groups.select("ids", "rows").mapInArrow(lambda it: _seed(it, dim, k, every), "query_id long, terms binary, floor long")
    queries = scratch.save(seeded.withColumn("query", F.monotonically_increasing_id()), "queries")
    n_queries = queries.count()
    batch = max(1, BATCH_BYTES // (8 * dim))
    n_chunks, n_batches = max(1, -(-groups.count() // CHUNK)), max(1, -(-n_queries // batch))
    dealt_to = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asking = queries.select("query", "terms", "floor", dealt_to("query", n_batches).alias("batch"), each(n_chunks).alias("chunk"))
    bounds = groups.select("gid", "most", "least", dealt_to("gid", n_chunks).alias("chunk"), each(n_batches).alias("batch"))
    reached = asking.groupBy("chunk", "batch").cogroup(bounds.groupBy("chunk", "batch")).applyInArrow(lambda a, b: _reach(a, b, dim), "gid long, queries array<long>")
    pairs = scratch.save(reached, "pairs")
    sizes = scratch.save(pairs.groupBy("gid").agg(F.ceil(F.sum(F.size("queries")) / batch).cast("int").alias("batches")), "sizes")
    sizes = small(sizes, sizes.count())
    asked = pairs.select("gid", F.explode("queries").alias("query")).join(small(queries, n_queries * dim * 8, BROADCAST_BYTES), "query").join(sizes, "gid")
    left = asked.select("gid", F.pmod(F.xxhash64("query"), F.col("batches")).alias("batch"), "query", "query_id", "terms", "floor")
    right = groups.join(sizes, "gid").select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - F.lit(1).cast("long"))).alias("batch"), "ids", "rows")
    near = left.groupBy("gid", "batch").cogroup(right.groupBy("gid", "batch")).applyInArrow(lambda a, b: _search(a, b, dim, k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
