"""Packing by concatenate and cut.

Pass 1 tokenizes each partition once, writes the ids to the shared folder with their place in the partition,
and sums tokens by partition. Prefix sums over the partition totals give every partition its global offset, so
pass 2 is a map: it cuts each document where the fixed windows of the one long token stream end. No row is
shuffled, and no document is ever held with another one's tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import bound_batches
from .common import Scratch, small

TOKENS = "doc_id long, part int, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
END = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a ``tokenizers`` JSON file (byte-level BPE without normalizer).

    If the same vocabulary lies beside it as ranks (``.tiktoken``), that faster reader gives the same ids.
    """
    import os

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})
        return lambda text: fast.encode(text, allowed_special="all") if END in text else fast.encode_ordinary(text)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: slow.encode(text, add_special_tokens=False).ids


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            piece = batch.slice(lo, 500)
            ids = [np.asarray([*encode(t or ""), end_id], "<u4").tobytes() for t in piece["text"].to_pylist()]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "before", "n", "ids"],
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, at, n, ids in zip(*(batch.slice(lo, 500)[c].to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(length - offset, n - start)
                    for column, x in zip(rows, (doc_id, start, take, ids[4 * start : 4 * (start + take)], n, sequence, offset), strict=True):
                        column.append(x)
                    start += take
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: the concatenation of all documents, cut.

    Each document is its ids and then ``end_id``. A piece (a boundary record) holds ``doc_id``, ``start`` and
    ``length`` in its document, ``ids`` as little-endian unsigned 32-bit integers, ``doc_tokens``, and
    ``sequence_id`` and ``offset`` of its place. Only the last sequence is shorter than ``length``.

    Null and empty texts are the one id ``end_id``; a null ``doc_id`` stays null; repeated rows are packed each;
    an empty table gives no pieces; other columns are ignored, whatever their names. A text longer than a
    sequence spans several. The order is that of the table as Spark read it.
    """
    bound_batches(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.save(source.mapInArrow(lambda it: _tokenize(it, tokenizer_path, end_id), TOKENS), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each partition of the input
    bases = scratch.save(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "bases")
    placed = tokens.join(small(bases, bases.count()), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(lambda it: _cut(it, length), PIECES)
