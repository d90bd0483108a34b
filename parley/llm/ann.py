"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is halved again and again at the median between two centres, which gives lists of equal size;
their means are the centroids. Every vector is indexed in its nearest list, and, if it lies near a boundary, in
the next ones too. A query walks the centroids' neighbour graph in memory, best first, and takes the lists whose
centroid is at most ``ratio`` times as far as the nearest. That ratio is calibrated on the sample: the smallest
with which the lists would hold the wanted share of true neighbours. So clustered data is pruned hard, and data
without structure little.

Lists live on the executors only, each split into blocks of bounded size, and the queries that chose a list into
batches; a task compares a block with a batch. The driver holds the sample and the centroids, both of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small
from .vectors import matrix, top, usable

#: Rows of the sample, vectors that a list should hold, and the most lists (an eighth of the sample).
SAMPLE, LIST, MOST_LISTS = 16_384, 512, 2048
#: A vector is also in lists up to so many times as far as its nearest, and in so many lists at most.
BOUNDARY, COPIES = 1.05, 4
#: Neighbours of a centroid in the graph; rows of a list's block; queries of a batch.
DEGREE, BLOCK, BATCH = 32, 8192, 2048
#: Bytes of the vectors of queries that may be broadcast.
BROADCAST_BYTES = 16 << 20
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class ListIndex:
    centroids: np.ndarray
    graph: np.ndarray
    ratio: float


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision; equal rows give equal values wherever they stand."""
    size = lambda x: np.sqrt((x * x).sum(axis=1))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore", under="ignore"):
        plain, norms = (a * b).sum(axis=1), size(a) * size(b)
        odd = ~np.isfinite(plain) | ~np.isfinite(norms) | (norms < 1e-280)
        out = plain / norms
    if odd.any():
        x, y = (v[odd] / np.abs(v[odd]).max(axis=1, keepdims=True) for v in (a, b))
        out[odd] = (x * y).sum(axis=1) / (size(x) * size(y))
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T))) + 1e-6


def _halves(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the rows, cut at the median between two centres."""
    centres = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        lean = x @ (centres[0] - centres[1])
        order = np.argsort(-lean, kind="stable")
        left, right = order[: len(x) // 2], order[len(x) // 2 :]
        centres = np.stack([x[left].mean(axis=0), x[right].mean(axis=0)])
    return left, right


def _in_lists(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every place that the rows have in the index."""
    d = _distance(x, centroids)
    near = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
    of = np.take_along_axis(d, near, axis=1)
    row, copy = np.nonzero(of <= BOUNDARY * of[:, :1])
    return row, near[row, copy]


def fit_lists(sample: np.ndarray, n_lists: int, k: int, recall: float, seed: int = 17) -> ListIndex:
    """Centroids, their graph and the ratio, from unit vectors."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(sample))]
    while 2 * len(parts) <= max(1, n_lists) and min(map(len, parts)) >= 2:
        parts = [part[half] for part in parts for half in _halves(sample[part], rng)]
    means = np.stack([sample[p].mean(axis=0) for p in parts])
    sizes = np.sqrt((means * means).sum(axis=1, keepdims=True))
    centroids = np.where(sizes > 1e-12, means / np.maximum(sizes, 1e-12), sample[[p[0] for p in parts]])
    d = _distance(centroids, centroids)
    nearest = np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, len(parts))]
    ring = np.stack([(np.arange(len(parts)) + 1) % len(parts), (np.arange(len(parts)) - 1) % len(parts)], axis=1)
    graph = np.concatenate([nearest, ring], axis=1)
    # what ratio each true neighbour of some sample rows would have needed
    asked = rng.permutation(len(sample))[:256]
    close = sample[asked] @ sample.T
    close[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-close, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    if not true.size:
        return ListIndex(centroids, graph, 1.0)
    to = _distance(sample[asked], centroids)
    row, of = _in_lists(sample, centroids)
    member = np.zeros((len(sample), len(parts)), bool)
    member[row, of] = True
    needed = np.where(member[true], (to / to.min(axis=1, keepdims=True))[:, None, :], np.inf).min(axis=2)
    return ListIndex(centroids, graph, float(np.quantile(needed, recall)) + 1e-9)


def walk(q: np.ndarray, index: ListIndex, sizes: np.ndarray, least: int) -> list[int]:
    """The lists of a unit vector: best first over the graph, until the next centroid is too far; on until ``least`` rows."""
    seen, heap, taken, rows, best = {0}, [(float(_distance(q[None], index.centroids[:1])[0, 0]), 0)], [], 0, np.inf
    strayed = 0
    while heap:
        d, at = heapq.heappop(heap)
        best = min(best, d)
        if d > index.ratio * best and rows >= least:
            strayed += 1  # beyond the bound: a few more, to leave a local hollow
            if strayed > 8:
                break
        taken.append((d, at))
        rows += int(sizes[at])
        new = [int(x) for x in index.graph[at] if int(x) not in seen]
        if new:
            new = list(dict.fromkeys(new))
            seen.update(new)
            for dist, x in zip(_distance(q[None], index.centroids[new])[0].tolist(), new, strict=True):
                heapq.heappush(heap, (dist, x))
    taken.sort()
    out, rows = [], 0
    for d, at in taken:
        if d > index.ratio * taken[0][0] and rows >= least:
            break
        out.append(at)
        rows += int(sizes[at])
    return out


def _place(batches: Iterator[pa.RecordBatch], dim: int, index: ListIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            row, of = _in_lists(units(matrix(part["embedding"], dim)), index.centroids)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), *(part[c].take(take) for c in ("row", "vec_id", "embedding"))], ["list", "row", "vec_id", "embedding"])


def _ask(batches: Iterator[pa.RecordBatch], dim: int, index: ListIndex, sizes: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """(list, query) for each list that a query asks."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            asked = [walk(q, index, sizes, least) for q in units(matrix(part["embedding"], dim))]
            query = np.repeat(np.asarray(part["query"], np.int64), [len(of) for of in asked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(asked).astype(np.int32)), pa.array(query)], ["list", "query"])


def _compare(queries: pa.Table, rows: pa.Table, dim: int, k: int) -> pa.Table:
    """The k nearest rows of one block for each query of a batch."""
    out: list[tuple] = []
    number, q_ids = (np.asarray(queries[c], np.int64) for c in ("query", "query_id"))
    places, ids = (np.asarray(rows[c], np.int64) for c in ("row", "vec_id"))
    if queries.num_rows and rows.num_rows:
        asked, held = matrix(queries["embedding"], dim), matrix(rows["embedding"], dim)
        unit = units(held)
        for lo in range(0, len(q_ids), 512):
            near = units(asked[lo : lo + 512]) @ unit.T
            near[q_ids[lo : lo + 512, None] == ids[None, :]] = -np.inf
            # whatever may be among the k best but for rounding; then exactly
            kth = np.partition(near, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
            for q, c in _few(near, kth - 1e-9):
                score = cosine(asked[lo + q], held[c])
                at, _ = top(q, score, ids[c], k)
                out.append((lo + q[at], c[at], score[at]))
    q, c, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"query": number[q], "query_id": q_ids[q], "row": places[c], "vec_id": ids[c], "score": s})


def _few(near: np.ndarray, floor: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (query, row) that reach the floor, whole queries at a time, about ``most`` places at once."""
    reach = (near >= floor[:, None]) & (near > -np.inf)
    ends = np.cumsum(reach.sum(axis=1))
    lo = 0
    while lo < len(near):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        q, c = np.nonzero(reach[lo:hi])
        yield q + lo, c
        lo = hi


def nearest(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, recall: float = 0.96, seed: int = 17) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k`` nearest other rows
    that were found, by cosine; of equal ones, smaller ids first.

    Null, empty and zero vectors, those with null or non-finite components, with another dimension than most, or
    with a null id take no part. Rows that share an id are not candidates of one another; each is a candidate of
    others, and each is a query with a list of its own. With fewer than ``k`` others, all are returned: a query whose
    lists hold fewer, as very many rows share its id, is compared with every list. An empty
    table gives no rows; other columns are ignored. ``recall`` is the share of true neighbours within the sample
    that calibrates the search.
    """
    rows, dim = usable(vectors)
    if not dim:
        return spark.createDataFrame([], RESULT)
    scratch = Scratch(spark)
    rows = rows.where(F.exists("embedding", lambda x: x != 0))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    order = F.xxhash64("vec_id", F.lit(seed))
    sample = rows.select("vec_id", "embedding", order.alias("r")).orderBy("r", "vec_id").limit(SAMPLE).toArrow()
    n_lists = min(MOST_LISTS, max(1, n // LIST))
    index = fit_lists(units(matrix(sample["embedding"], dim)), n_lists, k, recall, seed)
    shared = spark.sparkContext.broadcast(index)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    lists = scratch.save(numbered.mapInArrow(lambda it: _place(it, dim, shared.value), "list int, row long, vec_id long, embedding array<double>"), "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in lists.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[r["list"]] = r["count"]
    queries = scratch.save(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "embedding").withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = scratch.save(queries.mapInArrow(lambda it: _ask(it, dim, shared.value, sizes, 4 * (k + 1)), "list int, query long"), "asked")
    near = scratch.save(_search(asked, queries, lists, dim, k, seed), "near")
    # lists that are full of the query's own id may leave it short
    full = near.groupBy("query").count().where(F.col("count") >= k).select("query")
    short = scratch.save(queries.join(full, "query", "left_anti"), "short")
    if short.isEmpty():
        return near.drop("query")
    everywhere = short.select("query", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("list"))
    again = _search(scratch.save(everywhere, "everywhere"), short, lists, dim, k, seed)
    return near.join(short.select("query"), "query", "left_anti").unionByName(again).drop("query")


def _search(asked: DataFrame, queries: DataFrame, lists: DataFrame, dim: int, k: int, seed: int) -> DataFrame:
    """(query, query_id, rank, vec_id, score): the k best rows for each query in the lists that it asks."""
    # one row for each list: its blocks, and the batches of its queries
    blocks = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    meets = F.broadcast(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BATCH).cast("int").alias("batches")).join(blocks, "list"))
    dealt = lambda c, m: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    asking = asked.join(meets, "list").join(small(queries, queries.count() * dim * 8, BROADCAST_BYTES), "query")
    left = asking.select("list", each("blocks").alias("block"), dealt("query", "batches").alias("batch"), "query", "query_id", "embedding")
    right = lists.join(meets, "list").select("list", dealt("row", "blocks").alias("block"), each("batches").alias("batch"), "row", "vec_id", "embedding")
    key = ["list", "block", "batch"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _compare(a, b, dim, k), "query long, query_id long, row long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))  # a row lies in several lists
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")
