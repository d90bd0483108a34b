"""Sharding by balanced label propagation, with DataFrame functions only.

Documents of equal texts are linked. Each starts in a shard by its hash; then, in rounds, linked documents move
to the shard that most of their group is in and that has room, under quotas: a shard takes at most what its
capacity leaves and what leaves it. A group therefore meets in one shard, or, if it is larger than a shard, in
as few as can hold it. Documents without links cut no edge wherever they are; they come last. The longest of them (of
more than a LONG-th of a shard) go one by one to the shard that has least, and the others level the shards' bytes by
prefix sums, so that shards differ by about the longest of these others.

A round reads one row per linked document (a few numbers) and joins it with one row per group: by broadcast where
the counted groups are few, else with large groups split into parts. Only the matrix of bytes that want to move from
shard to shard reaches the driver.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_split, parts_of, small

#: About so many documents are in a bucket of the two-level prefix sums; there are at most MOST_BUCKETS.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 16_384
#: Groups that may be broadcast, at about 300 bytes each.
FEW_GROUPS = 50_000
#: A text of more than a LONG-th of a shard's bytes is placed on its own: fewer than LONG for each shard, whatever the table.
LONG = 1000


def _one_by_one(sizes: list[tuple[int, int]], loads: list[float]) -> dict[int, int]:
    """Shards for (size, key), the longest first and each where least is; ``loads`` are brought up to date."""
    heap = [(b, s) for s, b in enumerate(loads)]
    heapq.heapify(heap)
    placed: dict[int, int] = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[key], loads[shard] = shard, load + size
    return placed


def _quota(flow: list[list[float]], room: list[float]) -> list[float]:
    """The share of the bytes that want to move to each shard that may: room, and what leaves the shard meanwhile."""
    n = len(room)
    share = [1.0] * n
    for _ in range(20):
        for t in range(n):
            wanted = sum(flow[s][t] for s in range(n))
            leaves = sum(flow[t][s] * share[s] for s in range(n))
            share[t] = min(1.0, max(0.0, room[t] + leaves) / wanted) if wanted else 1.0
    return share


def _level(loads: list[float], rest: float) -> list[float]:
    """What each shard gets of ``rest`` so that the loads end as even as can be."""
    low, high = min(loads), max(loads) + rest
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(max(0.0, mid - x) for x in loads) < rest else (low, mid)
    return [max(0.0, high - x) for x in loads]


def _by_shard(values: list[float], shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), shard + 1)


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 8, rounds: int = 6, seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, linked, shard, slot): every row in one of ``n_shards`` shards of near equal bytes.

    ``size`` is the text's UTF-8 bytes plus 1; ``slot`` numbers a shard's rows from 0 without gaps. Equal texts
    are linked (empty ones too); a null text (size 1, checksum 0) is linked with nothing. Rows with a null or a
    repeated id are rows like others. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    text = F.col("text").cast("string")
    raw = text.cast("binary")
    base = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64(text)).alias("h1"),
            F.when(text.isNotNull(), F.xxhash64(F.lit(seed), text)).alias("h2"),
        ).withColumn("u", F.xxhash64("doc_id", "h1", "h2", F.monotonically_increasing_id(), F.lit(seed))),
        "base",
    )
    groups = scratch.save(base.where("h1 is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("linked", F.lit(True)), "groups")
    known = scratch.save(_with_groups(base, groups.drop("c"), groups).withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("shard", F.pmod("u", F.lit(n_shards)).cast("int")), "known")
    scratch.drop("base")
    sums = known.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("linked"), F.col("size"))).alias("linked")).first()
    total, rows, tied = sums["bytes"] or 0, sums["rows"], sums["linked"] or 0
    labels = _propagate(scratch, known.where("linked"), groups, n_shards, total / n_shards, rounds) if tied else known.where("linked")

    loads = [0.0] * n_shards
    for r in labels.groupBy("shard").agg(F.sum("size").alias("b")).collect():  # a row for each shard
        loads[r["shard"]] = float(r["b"])
    long = F.col("size") > total / n_shards / LONG
    longest = [(r["size"], r["u"]) for r in known.where(~F.col("linked") & long).select("size", "u").collect()]  # fewer than LONG for each shard
    placed_long = _one_by_one(longest, loads)
    fill = _level(loads, float(total - tied - sum(size for size, _ in longest)))
    ends = [sum(fill[: i + 1]) for i in range(n_shards)]

    n_buckets = min(MOST_BUCKETS, max(16, rows // BUCKET_ROWS))
    bucket = F.pmod(F.shiftright("u", 20), F.lit(n_buckets)).cast("int").alias("bucket")
    single = known.where(~F.col("linked") & ~long).select("*", bucket)
    own = known.where(~F.col("linked") & long).drop("shard").join(_table_of(spark, placed_long), "u").select("*", bucket)
    at = _offsets(single.groupBy("bucket").agg(F.sum("size").alias("b")), [], "b")
    order = Window.partitionBy("bucket").orderBy("u", "doc_id")
    middle = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    filled = single.join(small(at, n_buckets), "bucket").withColumn("m", middle)
    shard = F.least(F.lit(n_shards - 1), F.aggregate(F.array(*(F.lit(float(e)) for e in ends)), F.lit(0), lambda acc, e: acc + F.when(e < F.col("m"), 1).otherwise(0)))
    columns = ["doc_id", "size", "text_crc32", "linked", "u", "bucket"]
    levelled = filled.select(*columns, shard.cast("int").alias("shard"))
    placed = scratch.save(levelled.unionByName(own.select(*columns, "shard")).unionByName(labels.select("*", bucket).select(*columns, "shard")), "placed")

    first = _offsets(placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("b")), ["shard"], "b")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("u", "doc_id"))
    numbered = placed.withColumn("number", number).join(small(first, n_buckets * n_shards), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "linked", "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))


def _table_of(spark: SparkSession, placed: dict[int, int]) -> DataFrame:
    """(u, shard), to be broadcast."""
    rows = F.from_json(F.lit(json.dumps([{"u": u, "shard": shard} for u, shard in placed.items()])), "array<struct<u:long,shard:int>>")
    return F.broadcast(spark.range(1).select(F.inline(rows)))


def _with_groups(rows: DataFrame, one: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for each of some of the ``groups``."""
    n = groups.count()
    if n <= FEW_GROUPS:
        return rows.join(F.broadcast(one), ["h1", "h2"], "left")
    parts = parts_of(groups, "h1", "h2")
    return join_split(rows, one, ["h1", "h2"], small(parts, parts.count()), "u", "left")


def _offsets(sums: DataFrame, by: list[str], column: str) -> DataFrame:
    """Sums by bucket (at most MOST_BUCKETS a shard) with the column ``before``: what the buckets before it hold."""
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "bucket", F.coalesce(F.sum(column).over(w), F.lit(0)).alias("before"))


def _propagate(scratch: Scratch, labels: DataFrame, groups: DataFrame, n_shards: int, capacity: float, rounds: int) -> DataFrame:
    """Linked rows with the shards that they end in."""
    last = None
    for k in range(rounds):
        votes = labels.groupBy("h1", "h2", "shard").agg(F.sum("size").alias("b"))
        loads = [0.0] * n_shards
        for r in votes.groupBy("shard").agg(F.sum("b").alias("b")).collect():  # a row for each shard
            loads[r["shard"]] = float(r["b"])
        room = [capacity - x for x in loads]
        # a shard that is full attracts nobody in later rounds, but keeps its own
        opened = F.col("b") + F.lit(0) if k == 0 else F.when(_by_shard([float(x > 0.002 * capacity) for x in room], F.col("shard")) > 0, F.col("b")).otherwise(0)
        cells = votes.withColumn("pull", opened)
        best = cells.groupBy("h1", "h2").agg(F.max(F.struct("pull", (-F.col("shard")).alias("minus"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("votes"))
        wants = best.select("h1", "h2", (-F.col("best.minus")).alias("to"), F.col("best.pull").alias("pull"), "votes").where("pull > 0")
        # only from a shard with fewer votes; among equal ones, to the smaller
        moves = votes.join(wants.select("h1", "h2", "to", "pull"), ["h1", "h2"]).where("shard <> to and (b < pull or (b = pull and to < shard))")
        flow = [[0.0] * n_shards for _ in range(n_shards)]
        for r in moves.groupBy("shard", "to").agg(F.sum("b").alias("b")).collect():  # n_shards squared rows at most
            flow[r["shard"]][r["to"]] = float(r["b"])
        if not any(map(any, flow)):
            break
        share = _by_shard(_quota(flow, room), F.col("to"))
        # whole groups by their hash; groups too large for that row by row
        large = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda a, b: a + b) > 0.01 * capacity
        draw = F.pmod(F.when(F.col("large"), F.xxhash64("u", F.lit(k))).otherwise(F.xxhash64("h1", "h2", F.lit(k))), F.lit(1_000_003)) / 1_000_003.0
        goes = (F.col("to") != F.col("shard")) & ((F.col("own") < F.col("pull")) | ((F.col("own") == F.col("pull")) & (F.col("to") < F.col("shard")))) & (draw < share)
        moved = (
            _with_groups(labels, wants.withColumn("large", large), groups)
            .withColumn("own", F.element_at("votes", F.col("shard")))
            .select("doc_id", "size", "text_crc32", "h1", "h2", "u", "linked", F.when(F.coalesce(goes, F.lit(False)), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        )
        labels = scratch.save(moved, f"labels{k}")
        if last:
            scratch.drop(last)
        last = f"labels{k}"
    return labels
