"""Input lines to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_exit, strip


def take_until(rows: DataFrame, stop: Column, key: str, *order: str) -> DataFrame:
    """Each key's rows, in ``order``, that come before the first for which ``stop`` holds.

    A null ``stop`` doesn't stop; nulls of ``order`` come first. ``order`` must tell a key's rows apart. All columns
    stay as they are, whatever their names.
    """
    until = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stopped = F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(until)
    name = "stopped"
    while name in map(str.lower, rows.columns):
        name = f"_{name}"
    return rows.withColumn(name, stopped).where(F.col(name) == 0).drop(name)


def normalise_turns(lines: DataFrame, key: str = "conv_id", turn: str = "turn", line: str = "line") -> DataFrame:
    """Lines that are questions: stripped, up to the first exit word, without blank ones. Case is kept.

    Null turns come first; equal turns are in order of their lines.
    """
    before = take_until(lines, is_exit(F.col(line)), key, turn, line)
    return before.where(~is_blank(F.col(line))).withColumn(line, strip(F.col(line)))
