"""Micro-batch sinks that leave one copy however often a batch is run again."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from ..functions.shared import exists, make_empty

Sink = Callable[[DataFrame, int], None]


def table_sink(folder: str) -> Sink:
    """For ``foreachBatch``: each batch is a partition ``batch_id=<n>`` of the Parquet table ``folder``, written whole, and written anew
    if the batch runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def read_sink(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a ``table_sink`` has written: the rows, and ``batch_id``."""
    return spark.read.schema(f"{schema}, batch_id long").parquet(folder)


def console_sink(spark: SparkSession, folder: str, out: TextIO | None = None, err: TextIO | None = None) -> Sink:
    """For ``foreachBatch``: prints each answer once, in order of conversation and turn; failures to ``err``.

    A batch is marked in ``folder`` before its first line is printed. So a batch that runs again prints nothing; what a
    driver that dies in between has not printed stays unprinted, and is in the table of the answers. Rows come to
    the driver one partition at a time.
    """

    def show(batch: DataFrame, batch_id: int) -> None:
        mark = f"{folder}/printed-{batch_id}"
        if exists(spark, mark):
            return
        rows = batch.select("conv_id", "turn", "answer", "status", "error", "elapsed_s").orderBy("conv_id", "turn").toLocalIterator()
        make_empty(spark, mark)
        for r in rows:
            where = f"[{r['conv_id']}:{r['turn']}]"
            if r["status"] == "ok":
                print(f"{where} answered after {r['elapsed_s']:.2f} s\n{r['answer']}", file=out or sys.stdout, flush=True)
            else:
                print(f"{where} failed after {r['elapsed_s']:.2f} s: {r['error']}", file=err or sys.stderr, flush=True)

    return show


def both(*sinks: Sink) -> Sink:
    """Several sinks for one stream; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write
