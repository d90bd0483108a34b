"""Near duplicates by SuperMinHash, banding, verification on full sets and union-find.

1. Every text gets its shingle set's 128-bit key and BANDS band keys of ROWS signature values, in one pass. With
   40 bands of 6 values a pair at similarity 0.8 shares no band with a probability of 5e-6.
2. Texts with equal sets are one class; only classes go on, so exact copies cost one row however many they are.
3. In each bucket every class is paired with the smallest one only. Pairs are verified on their full sets, and
   linked classes become components.
4. Buckets that still hold several components are worked off whole: a pair of classes of different components is
   verified too (what is in one component already needs no more links). Few classes give such pairs one by one. Of
   many, a pair's sets must share one of their first elements in an order of all elements, rare ones before frequent
   ones: classes that share a first element are paired and verified. Where too many share one, they are dealt into
   blocks by their sets' sizes, and blocks whose sizes can meet are compared within tasks. No pair is dropped.
5. Components follow from union-find within partitions and star contraction between them.

No group of copies meets in one task: buckets are aggregated before they are shuffled, and a key of many rows is
split into parts before it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import bound_batches
from .common import BROADCAST_ROWS, Scratch, join_split, parts_of, small
from .shingles import band_keys, set_keys, shingle_sets, super_minhash

BANDS, ROWS = 40, 6
#: Hubs of up to so many classes give their pairs one by one; blocks of the larger ones hold about so many classes
#: and strays.
SMALL_HUB, HUB_BLOCK, STRAY_BLOCK = 16, 512, 256
#: A first element of more classes is frequent. Places that elements are counted in (a power of two).
FREQUENT, PLACES = 64, 1 << 18
#: Pairs of one class that are verified in one place.
SET_PART = 100


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, key, bands) of each row; key and bands are null for a text without words."""
    for batch in batches:
        lo = 0
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch["text"].cast(pa.large_binary())), 0), np.int64)
        while lo < batch.num_rows:  # about half a megabyte of text at once
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(lengths[lo:]), 1 << 19)) + lo)
            part = batch.slice(lo, hi - lo)
            lo = hi
            sets = list(shingle_sets(part["text"].to_pylist(), k))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys: list = [None] * len(sets)
            bucket: list = [None] * len(sets)
            if len(full):
                keyed = set_keys(np.concatenate(sets), sizes[full])
                for i, x in zip(full.tolist(), keyed, strict=True):
                    keys[i] = x.tobytes()
                # sets of many elements are signed alone, so that the permutations stay small
                for group in _portions(full, sizes):
                    signed = band_keys(super_minhash(np.concatenate([sets[i] for i in group]), sizes[group], bands * rows), bands).view(np.int64)
                    for i, x in zip(group.tolist(), signed, strict=True):
                        bucket[i] = x
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes), pa.array(keys, pa.binary()), pa.array(bucket, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "bands"])


def _portions(full: np.ndarray, sizes: np.ndarray, most: int = 1 << 14) -> Iterator[np.ndarray]:
    ends, lo = np.cumsum(sizes[full]), 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield full[lo:hi]
        lo = hi


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            sets = list(shingle_sets(part["text"].to_pylist(), k))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "elements"])


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a partition as stars: (node, smallest node it is linked with)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in parent]
    stars = [(x, y) for x, y in stars if x != y]
    for lo in range(0, len(stars), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars[lo : lo + 10_000]], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge in ``edges`` (a, b); the component is its smallest node.

    Partitions contract their edges by union-find; then large-star and small-star steps alternate until nothing
    changes. Each step is saved, so an executor that is lost costs one step at most.
    """
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = scratch.save(edges.select("a", "b").where("a <> b").mapInArrow(_union, "a long, b long").distinct(), "stars")
    seen, step = state(now), 0
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        after = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.save(after, f"stars{step}")
        scratch.drop("stars" if not step else f"stars{step - 1}")
        then, seen, now, step = seen, state(after), after, step + 1
        if then == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return scratch.save(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")


def _linked(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets share at least ``percent`` of a hundred of their union."""
    parts = scratch.save(parts_of(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "a", most=SET_PART), f"{name}_parts")
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    joined = join_split(pairs, left, "a", small(parts, parts.count()), "b").join(right, "b")
    return joined.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def _block_links(asked: pa.Table, held: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between the ``asked`` and the ``held`` classes of a hub that are of different components."""
    links: list[tuple[int, int]] = []
    if asked.num_rows and held.num_rows:
        sets = held["elements"].combine_chunks()
        elements, sizes = np.asarray(sets.flatten(), np.int64), np.diff(np.asarray(sets.offsets))
        order = np.argsort(elements, kind="stable")
        elements, owner = elements[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        nodes, parts = np.asarray(held["node"], np.int64), np.asarray(held["component"], np.int64)
        for node, part, own in zip(asked["node"].to_pylist(), asked["component"].to_pylist(), asked["elements"], strict=True):
            x = np.asarray(own.values, np.int64)
            lo, hi = np.searchsorted(elements, x, "left"), np.searchsorted(elements, x, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(sizes))
            for i in np.flatnonzero((100 * shared >= percent * (sizes + len(x) - shared)) & (parts != part)):
                links.append((node, int(nodes[i])))
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _residual(scratch: Scratch, buckets: DataFrame, crowded: DataFrame, labels: DataFrame, tested: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that buckets hold apart.

    A bucket's hub is its pivot's component; what is in the bucket but not in that component strayed. All strays of
    a hub are candidates of all classes in the hub's open buckets, so every pair that shares a bucket is.
    """
    own = labels.select("node", "component")
    hubs = labels.select(F.col("node").alias("pivot"), F.col("component").alias("hub"))
    n_labels = labels.count()
    tagged = buckets.join(small(own, n_labels), "node", "left").join(small(hubs, n_labels), "pivot", "left")
    tagged = tagged.select("bucket", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("hub", "pivot").alias("hub"))
    opened = scratch.save(tagged.where("component <> hub").select("bucket").distinct(), "opened")
    n_opened = opened.count()
    if n_opened <= BROADCAST_ROWS:
        in_open = tagged.join(F.broadcast(opened), "bucket", "left_semi")
    else:
        in_open = join_split(tagged, opened, "bucket", crowded, "node", "left_semi")
    members = in_open.select("hub", "node", "n", "component").distinct()
    members = scratch.save(members.withColumn("stray", F.col("component") != F.col("hub")), "members")
    sizes = scratch.save(members.groupBy("hub").agg(F.count(F.lit(1)).alias("c")), "hubs")
    is_small = F.col("c") <= SMALL_HUB
    sized = members.join(small(sizes, sizes.count()), "hub")
    # few: pairs, but for those with the pivot that the first round has tested
    few = sized.where(is_small)
    pairs = scratch.save(_apart(few, few, "hub", percent).join(tested, ["a", "b"], "left_anti"), "few")
    large = scratch.save(sized.where(~is_small).drop("c"), "large")
    if large.isEmpty():
        return _linked(scratch, pairs, sets, percent, "few")
    rare, blocked = _large_hubs(scratch, large, sets, percent)
    both = scratch.save(pairs.unionByName(rare.join(tested, ["a", "b"], "left_anti")).distinct(), "both")
    return _linked(scratch, both, sets, percent, "both").unionByName(blocked)


def _apart(strays: DataFrame, classes: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs (a, b) of a stray and a class that share ``key``, are of different components and whose sizes allow a link."""
    left = strays.where("stray").select(key, F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("component").alias("x_part"))
    right = classes.select(key, F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("component").alias("y_part"), F.col("stray").alias("y_stray"))
    apart = F.expr(f"x_part <> y_part and (x < y or not y_stray) and 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)")
    return left.join(right, key).where(apart).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _first_elements(batches: Iterator[pa.RecordBatch], counts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The rows with ``firsts`` for ``elements``: the first ones in order of their places' counts, then of their values."""
    for batch in batches:
        firsts = []
        for own in batch["elements"]:
            x = np.asarray(own.values, np.int64)
            order = np.lexsort((x, counts[x & (len(counts) - 1)]))
            firsts.append(x[order[: len(x) + 1 + (-percent * len(x)) // 100]])
        names = ["node", "n", "component", "stray"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(firsts, pa.list_(pa.int64()))], [*names, "firsts"])


def _large_hubs(scratch: Scratch, large: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the classes of large hubs: pairs to verify that share a first element of few classes, and links of the others.

    Two sets that link share an element among the first ``n - ceil(percent * n / 100) + 1`` of each, in any order
    that holds for all sets. Rare elements come first here: the order is that of counts in PLACES places that
    elements are hashed to. A class one of whose first elements is shared by many classes is an "other".
    """
    nodes = large.groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.max("stray").alias("stray"))
    bags = scratch.save(nodes.join(sets, "node"), "bags")
    place = F.explode(F.transform("elements", lambda e: e.bitwiseAND(PLACES - 1).cast("int"))).alias("place")
    seen = bags.select(place).groupBy("place").count().toArrow()  # PLACES rows at most
    counts = np.zeros(PLACES, np.int64)
    counts[np.asarray(seen["place"])] = np.asarray(seen["count"])
    shared = scratch.spark.sparkContext.broadcast(counts)
    firsts = bags.mapInArrow(lambda it: _first_elements(it, shared.value, percent), "node long, n int, component long, stray boolean, firsts array<long>")
    heads = scratch.save(firsts.select("node", "n", "component", "stray", F.explode("firsts").alias("element")), "heads")
    frequent = scratch.save(heads.groupBy("element").count().where(F.col("count") > FREQUENT).select("element"), "frequent")
    frequent = small(frequent, frequent.count())
    rare = heads.join(frequent, "element", "left_anti")
    pairs = _apart(rare, rare, "element", percent)

    # others by size: those that link are of one or of neighbouring sizes
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.001 * 100 / percent))).cast("int").alias("size")
    others = bags.join(heads.join(frequent, "element", "left_semi").select("node").distinct(), "node", "left_semi").select("node", "elements")
    left = scratch.save(large.join(others.select("node"), "node", "left_semi").select("hub", "node", "component", "stray", size), "left")
    asking = left.where("stray").select("hub", "node", "component", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"))
    columns = asking.groupBy("hub", "size").agg(F.ceil(F.count(F.lit(1)) / STRAY_BLOCK).cast("int").alias("columns"))
    blocks = scratch.save(left.groupBy("hub", "size").agg(F.ceil(F.count(F.lit(1)) / HUB_BLOCK).cast("int").alias("rows")).join(columns, ["hub", "size"]), "blocks")
    blocks = small(blocks, blocks.count())
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["hub", "size", "row", "column"]
    asked = asking.join(blocks, ["hub", "size"]).join(others, "node").select("hub", "size", place("columns").alias("column"), spread_to("rows").alias("row"), "node", "component", "elements")
    # named anew, as both sides come from the same tables
    again = [F.col(c).alias(c) for c in ("hub", "size", "node", "component", "elements")]
    held = left.join(blocks, ["hub", "size"]).join(others, "node").select(*again, spread_to("columns").alias("column"), place("rows").alias("row"))
    return pairs, asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(lambda x, y: _block_links(x, y, percent), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked if their sets of ``shingle``-word shingles share at least ``percent`` of a hundred of
    their union; ``component_id`` is the smallest id that links reach, and the row with it is kept.

    A text without words (null, empty, blank) has an empty set, is linked with nothing and stays. Equal sets are
    linked. Rows that share an id count as one document and get one component, whatever their texts. A row without an id is
    linked with nothing, has no component and is kept. Texts are read whole, however long. An empty table gives no
    rows; other columns are ignored.
    """
    bound_batches(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(source.mapInArrow(lambda it: _sign(it, shingle, bands, rows), "doc_id long, n_shingles long, key binary, bands array<long>"), "signed")
    # an id's texts, by their sets; no text counts as one of its own
    texts = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("key", F.lit(b""))).alias("one"), F.max(F.coalesce("key", F.lit(b""))).alias("other"))
    if not texts.where("one < other").isEmpty():
        scratch.drop("signed")
        return _by_parts(scratch, source, shingle, percent, bands, rows)
    members = signed.where("key is not null and doc_id is not null")
    classes = scratch.save(members.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("c")), "classes")
    spread = classes.select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    pivots = scratch.save(spread.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count(F.lit(1)).alias("c")).where("pivot < last"), "pivots")
    crowded = parts_of(pivots, "bucket")
    crowded = small(crowded, crowded.count())
    buckets = scratch.save(join_split(spread, pivots.select("bucket", "pivot"), "bucket", crowded, "node"), "buckets")
    nodes = scratch.save(buckets.select("node").distinct(), "nodes")
    n_nodes = nodes.count()
    labels = nodes.select("node", F.col("node").alias("component")).limit(0)
    if n_nodes:
        wanted = source.join(small(nodes, n_nodes), F.col("doc_id") == F.col("node"), "left_semi")
        sets = scratch.save(wanted.mapInArrow(lambda it: _full_sets(it, shingle), "node long, elements array<long>"), "sets")
        stars = scratch.save(buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "stars_of_pivots")
        links = scratch.save(_linked(scratch, stars, sets, percent, "stars"), "links")
        labels = components(scratch, links)
        more = scratch.save(_residual(scratch, buckets, crowded, labels, stars, sets, percent), "more")
        if more.count():
            labels = components(scratch, links.unionByName(more))
        scratch.drop("members", "few", "large", "both", "bags", "heads", "left", "stars_of_pivots", "sets")
    scratch.drop("buckets", "pivots")
    # a class of one document that nothing is linked with is its own component
    named = classes.join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    copied = parts_of(classes, "key")
    keyed = signed.where("doc_id is not null and key is not null").select("doc_id", "n_shingles", "key")
    known = join_split(keyed, named, "key", small(copied, copied.count()), "doc_id").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where("doc_id is not null and key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    own = known.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    rest = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return own.unionByName(rest)


def _by_parts(scratch: Scratch, docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``near_duplicates`` of a table where an id stands on several texts.

    Each pair of an id and a text gets a number, which grows with the id, and the numbers are grouped; then an id links
    the groups of its texts.
    """
    spark = scratch.spark
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    pairs = hashed.where("doc_id is not null").select(F.col("doc_id").alias("part_id"), F.col("hash").alias("part_hash")).distinct().orderBy("part_id", "part_hash")
    parts = scratch.save(pairs.withColumn("part", F.monotonically_increasing_id()), "parts")
    n = parts.count()
    same = (F.col("doc_id") == F.col("part_id")) & (F.col("hash") == F.col("part_hash"))
    numbered = scratch.save(hashed.join(small(parts, n), same, "left").select(F.col("part").alias("doc_id"), "text"), "numbered")
    found = scratch.save(near_duplicates(spark, numbered, shingle, percent, bands, rows).select(F.col("doc_id").alias("part"), "n_shingles", F.col("component_id").alias("group")), "found")
    of_part = found.where("part is not null").select("part", "group").distinct()
    groups = of_part.join(small(parts, n), "part").select("part_id", "group").distinct()
    first = groups.groupBy("part_id").agg(F.min("group").alias("a"), F.max("group").alias("last")).where("a < last").select("part_id", "a")
    links = scratch.save(groups.join(first, "part_id").where("a < group").select("a", F.col("group").alias("b")).distinct(), "links_of_ids")
    labels = scratch.save(components(scratch, links).select(F.col("node").alias("group"), "component"), "labels_of_groups")
    # numbers grow with ids, so the smallest number of a component is of its smallest id
    roots = of_part.select("group").distinct().join(small(labels, labels.count()), "group", "left").select("group", F.coalesce("component", "group").alias("part"))
    ids = parts.select("part", "part_id")
    named = scratch.save(roots.join(small(ids, n), "part").select("group", F.col("part_id").alias("component_id")), "named")
    own = found.where("part is not null").join(small(ids, n), "part").join(small(named, named.count()), "group")
    own = own.select(F.col("part_id").alias("doc_id"), "n_shingles", "component_id", (F.col("part_id") == F.col("component_id")).alias("kept"))
    rest = found.where("part is null").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return own.unionByName(rest)
