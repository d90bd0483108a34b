"""Conversations in batch: one fold for each, in parallel between conversations, in order within one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import bound_batches, gathered
from ..functions.text import is_blank
from ..operators.ledger import AnswerLedger, ask_once, bucket_of
from ..operators.models import Backend, Conversation, Outcome, WorkerBackend
from ..operators.transcripts import END, committed

ANSWERS = "conv_id long, turn long, question string, answer string, status string, error string, elapsed_s double, n_messages long"
_COLUMNS = {
    "conv_id": pa.int64(), "turn": pa.int64(), "question": pa.string(), "answer": pa.string(), "status": pa.string(), "error": pa.string(), "elapsed_s": pa.float64(), "n_messages": pa.int64(),
}
#: Kinds of a conversation's rows, in the order in which they are folded.
PROMPT, MESSAGE, KNOWN, LINE = range(4)
_OUTCOME = "answer string, status string, error string, elapsed_s double, n_messages long"


def _rows(df: DataFrame, kind: int, turn: Column | None, line: str, role: Column | None = None, nth: Column | None = None, known: bool = False) -> DataFrame:
    """Rows of one kind in the shape that all kinds share."""
    null = lambda t: F.lit(None).cast(t)
    outcome = F.struct(*(F.col(c.split()[0]) for c in _OUTCOME.split(", "))) if known else null(f"struct<{_OUTCOME.replace(' ', ':').replace(',:', ',')}>")
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit(kind).alias("kind"), (null("long") if turn is None else turn.cast("long")).alias("turn"),
        (null("string") if role is None else role).alias("role"), F.col(line).cast("string").alias("line"), (F.lit(0).cast("long") if nth is None else nth).alias("nth"), outcome.alias("known"),
    )


def answer(turns: DataFrame, backend: Callable[[], Backend], prompts: DataFrame | None = None, history: DataFrame | None = None, ledger: AnswerLedger | None = None) -> DataFrame:
    """What came of each question of ``turns`` (conv_id, turn, line); ``prompts`` (conv_id, system_prompt) seeds them.

    Lines are asked in order of ``turn``, null turns first and equal ones in order of the line. Blank lines are
    dropped before the shuffle; an exit word ends its conversation, and no line after it is asked. Of several
    prompts of a conversation the first in order of text holds; null ones count as none. Null ``conv_id``s are one
    conversation. Conversations are sorted by Spark and folded row by row, so a worker holds the messages of one
    at a time, however many lines it has.

    A conversation goes on from ``history``, a transcript (conv_id, turn, role, text): what it committed stands
    before the lines, in order of its own turns. A recorded system message seeds the conversation unless a prompt does.
    A row of the role ``end`` (see ``transcript_of``) ends the conversation: none of its lines is asked.

    The model is called when Spark runs the plan, and again whenever it runs it again, unless a ``ledger`` has the
    answer: then a question is asked once, whatever fails or runs anew. Without one, persist or write the result before
    using it twice, and run such jobs with ``spark.task.maxFailures=1`` and without speculation.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    lines = _rows(turns.where(~is_blank(F.col("line"))), LINE, F.col("turn"), "line")
    if prompts is not None:
        seeds = prompts.where("system_prompt is not null").groupBy("conv_id").agg(F.min("system_prompt").alias("line"))
        lines = lines.unionByName(_rows(seeds, PROMPT, None, "line"))
    if history is not None:
        lines = lines.unionByName(_rows(committed(history), MESSAGE, F.col("turn"), "text", F.col("role")))
    if ledger is not None:
        lines = lines.unionByName(_rows(ledger.read(spark), KNOWN, F.col("turn"), "question", nth=F.col("nth"), known=True))
    made = WorkerBackend(backend)
    if ledger is not None:  # a log's conversations in one task, one after another
        return gathered(lines.withColumn("bucket", bucket_of(F.col("conv_id"))), "bucket", "conv_id", "kind", "turn", "line").mapInArrow(lambda it: _fold(it, made, ledger), ANSWERS)
    return gathered(lines, "conv_id", "kind", "turn", "line").mapInArrow(lambda it: _fold(it, made, ledger), ANSWERS)


def _fold(batches: Iterator[pa.RecordBatch], backend: Callable[[], Backend], ledger: AnswerLedger | None) -> Iterator[pa.RecordBatch]:
    """Answers to the lines of conversations that follow one another, each led by what it goes on from."""
    now: object = _fold  # no conversation's id
    talk, prompted = Conversation(), False
    known: dict[tuple, Outcome] = {}
    came: Counter[tuple] = Counter()
    log = ledger.log() if ledger is not None else None
    for batch in batches:
        out = []
        for conv_id, kind, turn, role, line, nth, given in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "turn", "role", "line", "nth", "known")), strict=True):
            if conv_id != now:
                now, talk, prompted, known, came = conv_id, Conversation(), False, {}, Counter()
            if kind == PROMPT:
                talk.messages, prompted = [{"role": "system", "content": line}], True
            elif kind == MESSAGE:
                if role == END:
                    talk.ended = True
                elif role != "system" or not prompted:
                    talk.messages.append({"role": role, "content": line})
            elif kind == KNOWN:
                known[turn, line, nth] = Outcome(line, *given.values())
            else:
                key = (turn, line.strip())
                o = ask_once(talk, line, backend(), log, conv_id, turn, came[key], known.get((*key, came[key])))
                came[key] += 1
                if o:
                    out.append((conv_id, turn, o.question, o.answer, o.status, o.error, o.elapsed_s, o.n_messages))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(_COLUMNS.values())], list(_COLUMNS))
