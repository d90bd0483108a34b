"""The prefix trie of conversations, as rows.

Each conversation is one row: its turns' digests in order, as one binary key. The rows are range-sorted over the whole
cluster, so that a node's members lie next to each other. A sweep over each partition compares neighbours (their longest
common prefix), keeps the open nodes on a stack and writes a node when it closes. Nodes on the paths of a partition's
first and last rows may go on in other partitions: of them the sweep writes pieces, and one pass over the pieces alone
stitches them. A last sweep, backwards through each partition's nodes, gives each node its parent's name.

A sweep holds one path, never a partition or a node's members. A conversation is one row of 16 bytes and a
length for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small

#: Bytes of a turn's digest in a key.
DIGEST = 16
#: A conversation starts as the first of its WINDOW does, for fewer than HEADS turns.
WINDOW, HEADS = 100, 6
#: Ids that end at one node are hashed in runs of so many.
CHUNK = 20_000

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FIELDS = {
    "part": pa.int32(), "seq": pa.int64(), "kind": pa.int32(), "depth": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "chars": pa.int64(), "ends": pa.string(), "run": pa.int64(), "text": pa.string(), "first": pa.binary(), "last": pa.binary(),
}
SWEPT = (
    "part int, seq long, kind int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string, run long, text string, "
    "first binary, last binary"
)
#: Kinds of swept rows, in the order in which they are stitched: a closed node; a partition's end keys; ids that end at
#: the first path's node; pieces of the first path; ids that end at a later node; pieces of the last path.
CLOSED, ENDS, FIRST_IDS, FIRST, LATER_IDS, LAST = range(6)
#: What a node without ends has.
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(slots=True)
class _Node:
    """What is known of an open node: sums over its closed children and the conversations that end at it."""

    chars: int = 0
    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: str | None = None
    hashed: object = None
    pieces: list[tuple[int, int]] = field(default_factory=list)

    def member(self, conv_id: int | None) -> None:
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id

    def close(self) -> None:
        self.n_leaves = self.n_leaves if self.n_children else 1
        self.saved += (self.n_convs - 1) * self.chars

    def take(self, child: _Node) -> None:
        self.member(child.conv_id)
        self.n_convs += child.n_convs
        self.n_children += 1
        self.n_leaves += child.n_leaves
        self.saved += child.saved

    def add_ids(self, text: str) -> None:
        """The next ids that end here, comma-joined."""
        if self.hashed is None:
            self.hashed = hashlib.sha256(text.encode())
        else:
            self.hashed.update(b"," + text.encode())

    def digest(self) -> str | None:
        return self.hashed.hexdigest() if self.hashed is not None else self.ends


def shared_depth(a: bytes, b: bytes) -> int:
    """How many turns two keys have in common at their start."""
    least = min(len(a), len(b)) // DIGEST
    if a[: least * DIGEST] == b[: least * DIGEST]:
        return least
    low, high = 0, least  # keys agree in the first `low` turns, and not in the first `high`
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low


class _Out:
    """Rows for ``_FIELDS``, numbered in order within their partition."""

    def __init__(self, part: int):
        self.part, self.seq, self.rows = part, 0, []

    def add(self, kind: int, depth: int = 0, node: _Node | None = None, **more) -> None:
        row = {"part": self.part, "seq": self.seq, "kind": kind, "depth": depth, **more}
        if node is not None:
            row |= {"conv_id": node.conv_id, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": node.n_leaves, "saved_tokens": node.saved, "chars": node.chars, "ends": node.digest()}
        self.seq += 1
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _FIELDS.items()], list(_FIELDS))


def _sweep(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, chars, conv_id) of one partition to closed nodes and pieces of open ones."""
    out = _Out(TaskContext.get().partitionId())
    path: list[_Node] = []
    first = last = None
    on_first, run, ids = 0, 0, []  # how deep the path is still the first row's; the number of this run of equal keys; its ids

    def keep(node: _Node, ended: bool) -> None:
        """Ids of the run so far into its node; as rows, too, if another partition may have more of them."""
        nonlocal ids
        text, ids = ",".join(map(str, ids)), []
        if not text:
            return
        if run:
            node.add_ids(text)
        if not run or not ended:
            out.add(LATER_IDS if run else FIRST_IDS, run=run, text=text)

    for batch in batches:
        for key, chars, conv_id in zip(*(batch[c].to_pylist() for c in ("key", "chars", "conv_id")), strict=True):
            depth, shared = len(key) // DIGEST, -1
            if last is None:
                first, on_first = key, depth
            elif key == last:
                shared = depth
            else:
                keep(path[-1], True)
                run += 1
                shared = shared_depth(last, key)
                while len(path) > shared + 1:
                    at = len(path) - 1
                    node = path.pop()
                    if at <= on_first:
                        out.add(FIRST, at, node)
                    else:
                        node.close()
                        path[-1].take(node)
                        out.add(CLOSED, at, node)
                on_first = min(on_first, shared)
            path += [_Node(chars[at - 1] if at else 0) for at in range(shared + 1, depth + 1)]
            path[-1].n_convs += 1
            path[-1].member(conv_id)
            ids.append(conv_id)
            if len(ids) >= chunk:
                keep(path[-1], False)
            last = key
        yield out.batch()
    if last is not None:
        keep(path[-1], False)
        path[-1].hashed = None  # what ends at the last row's node is hashed from its rows
        out.add(ENDS, on_first, run=run, first=first, last=last)
        for at in range(len(path) - 1, -1, -1):
            out.add(LAST, at, path[at])
        yield out.batch()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and end keys, in order of partition and kind, to the nodes that they are of: a row for each piece, with
    the node's values; ``kind`` is 0 for the one of them that stands for the node."""
    path: list[_Node] = []
    last, on_first, last_run, moved = None, 0, 0, False
    rows: list[dict] = []

    def cut(depth: int) -> None:
        """Closes what is deeper."""
        while len(path) > depth + 1:
            at = len(path) - 1
            node = path.pop()
            node.close()
            if path:
                path[-1].take(node)
            for i, (part, seq) in enumerate(node.pieces):
                done = {"part": part, "seq": seq, "kind": int(i > 0), "depth": at, "conv_id": node.conv_id}
                rows.append(done | {"n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": node.n_leaves, "saved_tokens": node.saved, "ends": node.digest()})

    def batch() -> pa.RecordBatch:
        nonlocal rows
        taken, rows = rows, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in taken], t) for c, t in _FIELDS.items()], list(_FIELDS))

    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == ENDS:
                cut(-1 if last is None else shared_depth(last, r["first"]))
                path += [_Node() for _ in range(len(path), len(r["first"]) // DIGEST + 1)]
                last, on_first, last_run, moved = r["last"], r["depth"], r["run"], False
                continue
            if r["kind"] > FIRST and not moved:
                cut(on_first)
                path += [_Node() for _ in range(len(path), len(last) // DIGEST + 1)]
                moved = True
            if r["kind"] == FIRST_IDS or r["kind"] == LATER_IDS and r["run"] == last_run:
                path[-1].add_ids(r["text"])
            elif r["kind"] in (FIRST, LAST):
                node = path[r["depth"]]
                node.chars, node.ends = r["chars"], node.ends or r["ends"]
                node.member(r["conv_id"])
                node.n_convs += r["n_convs"]
                node.n_children += r["n_children"]
                node.n_leaves += r["n_leaves"]
                node.saved += r["saved_tokens"]
                node.pieces.append((r["part"], r["seq"]))
        yield batch()
    cut(-1)
    yield batch()


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's nodes backwards, so that a node comes after its parent: (NODE) of those of kind 0."""
    names: dict[int, int] = {}
    columns = ("conv_id", "depth", "kind")
    for batch in batches:
        parents, chosen = [], []
        for i, (conv_id, depth, kind) in enumerate(zip(*(batch[c].to_pylist() for c in columns), strict=True)):
            names[depth] = conv_id
            if not kind:
                parents.append(names[depth - 1] if depth else None)
                chosen.append(i)
        rows = batch.take(pa.array(chosen, pa.int64()))
        ends = rows["ends"].fill_null(NO_ENDS)
        named = [rows["conv_id"], rows["depth"], pa.array(parents, pa.int64()), *(rows[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ends]
        yield pa.RecordBatch.from_arrays(named, [c.split()[0] for c in NODE.split(", ")])


def turn_digest(role: Column, text: Column) -> Column:
    """DIGEST bytes for a turn. The role's length stands before it, so that no two turns run together alike."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST))


def rebuilt_turns(scratch: Scratch, conversations: DataFrame, window: int = WINDOW, heads: int = HEADS) -> DataFrame:
    """(conv_id, key, chars): every conversation with the first h turns of the first of its ``window`` (if there is
    one) in place of its own first h; h is crc32 of its id as text, modulo ``heads``.

    Turns are in order of ``turn``, null first; equal ones in order of their digests. Only ids, digests and lengths
    are shuffled, never texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.length(text).alias("chars"))
    own = scratch.save(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("own")), "own")
    first = F.col("conv_id") - F.col("conv_id") % window
    firsts = own.where(F.col("conv_id") % window == 0).select(F.col("conv_id").alias("first_id"), F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    # a head is a few hundred bytes; its window has a hundred ids at most on each side of zero
    joined = own.join(small(firsts, firsts.count(), 50_000), first == F.col("first_id"), "left")
    turns_of = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    key = F.unhex(F.array_join(F.transform(F.col("turns"), lambda t: F.hex(t["digest"])), ""))
    return joined.select("conv_id", turns_of.alias("turns")).select("conv_id", key.alias("key"), F.col("turns.chars").alias("chars"))


def prefix_trie(spark: SparkSession, conversations: DataFrame, window: int = WINDOW, heads: int = HEADS, chunk: int = CHUNK) -> DataFrame:
    """(NODE) of every distinct prefix of the rebuilt conversations, the empty one included.

    Null roles and texts are empty; a null ``turn`` comes first. Rows without ``conv_id`` take no part; a row that
    stands there twice is two turns. A conversation may be rebuilt to no turns at all: it ends at the root. Without
    conversations there are no nodes. Other columns don't matter, whatever their names.
    """
    scratch = Scratch(spark)
    rows = rebuilt_turns(scratch, conversations.select("conv_id", "turn", "role", "text"), window, heads)
    # ties in the key are dealt by id: a node with very many equal conversations is several partitions' work
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = scratch.save(ordered.mapInArrow(lambda it: _sweep(it, chunk), SWEPT), "swept")
    scratch.drop("own")
    pieces = swept.where(F.col("kind") > CLOSED).repartition(1).sortWithinPartitions("part", "kind", "seq")
    stitched = scratch.save(pieces.mapInArrow(_stitch, SWEPT), "stitched")
    columns = ("part", "seq", "kind", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    nodes = swept.where(F.col("kind") == CLOSED).select(*columns).unionByName(stitched.select(*columns))
    return nodes.repartition("part").sortWithinPartitions("part", F.desc("seq")).mapInArrow(_parents, NODE)
