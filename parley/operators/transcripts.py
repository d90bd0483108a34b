"""Recorded conversations: what was committed, and what each request carried.

A transcript has rows (conv_id, turn, role, text). A question whose next row isn't an answer failed and left no
trace in later requests. All functions share one hash exchange on ``conv_id`` and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import is_exit

ROLES = ("system", "user", "assistant")
#: The role of a row that ends a recorded conversation: no line after it is asked.
END = "end"


def _order() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def _answered() -> Column:
    return F.coalesce(F.lead("role").over(_order()) == "assistant", F.lit(False))


def _marked(transcript: DataFrame) -> DataFrame:
    return transcript.select("conv_id", "turn", "role", "text").withColumn("_next", F.lead("text").over(_order())).withColumn("_kept", (F.col("role") != "user") | _answered())


def committed(transcript: DataFrame) -> DataFrame:
    """The transcript without failed questions."""
    return _marked(transcript).where("_kept").select("conv_id", "turn", "role", "text")


def conversation_arrays(transcript: DataFrame) -> DataFrame:
    """(conv_id, messages, asked): each conversation once. ``messages`` are all that it committed, in order; ``asked`` are its
    questions, as (turn, question, ok, n_before): a question's request is the first ``n_before`` messages, and itself.

    So a conversation takes memory by its length, and not by the square of it: ``request_of`` makes a request when it's read.
    """
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    n_before = F.coalesce(F.sum(F.col("_kept").cast("int")).over(before), F.lit(0)).cast("int")
    marked = _marked(transcript).withColumns({"_place": F.row_number().over(_order()), "_before": n_before})
    rows = F.sort_array(F.collect_list(F.struct("_place", "turn", "role", "text", "_kept", "_before")))
    said = F.transform(F.filter("rows", lambda r: r["_kept"]), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    asked = F.transform(
        F.filter("rows", lambda r: r["role"] == "user"),
        lambda r: F.struct(r["turn"].alias("turn"), r["text"].alias("question"), r["_kept"].alias("ok"), r["_before"].alias("n_before")),
    )
    return marked.groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", said.alias("messages"), asked.alias("asked"))


def request_of(messages: Column, question: Column, n_before: Column) -> Column:
    """The messages of one request."""
    return F.concat(F.slice(messages, F.lit(1), n_before), F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))))


def requests(transcript: DataFrame) -> DataFrame:
    """(conv_id, turn, status, messages) of every question: all that was committed before it, and itself."""
    each = conversation_arrays(transcript).select("conv_id", "messages", F.explode("asked").alias("q"))
    return each.select("conv_id", "q.turn", F.when(F.col("q.ok"), "ok").otherwise("error").alias("status"), request_of(F.col("messages"), F.col("q.question"), F.col("q.n_before")).alias("messages"))


def history_at_turn(transcript: DataFrame) -> DataFrame:
    """(conv_id, turn, messages) of every question that was answered."""
    return requests(transcript).where("status = 'ok'").drop("status")


def request_sizes(transcript: DataFrame) -> DataFrame:
    """(conv_id, turn, n_messages, n_chars) of every question's request, without building the messages."""
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    count = F.coalesce(F.sum(F.col("_kept").cast("long")).over(before), F.lit(0)) + 1
    chars = F.coalesce(F.sum(F.when(F.col("_kept"), F.length("text")).otherwise(0)).over(before), F.lit(0)) + F.coalesce(F.length("text"), F.lit(0))
    sized = _marked(transcript).withColumns({"n_messages": count.cast("long"), "n_chars": chars.cast("long")})
    return sized.where("role = 'user'").select("conv_id", "turn", "n_messages", "n_chars")


def outcomes(transcript: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer, status) of every question, replayed from the transcript."""
    ok = F.col("_kept")
    asked = _marked(transcript).where("role = 'user'")
    return asked.select("conv_id", "turn", F.col("text").alias("question"), F.when(ok, F.col("_next")).alias("answer"), F.when(ok, "ok").otherwise("error").alias("status"))


def first_choice(response: Column) -> Column:
    """The first choice's content of a response struct; null if there are no choices."""
    return F.get(response["choices"], 0)["message"]["content"]


def transcript_of(answers: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Answers as a transcript (conv_id, turn, role, text) to go on from: two rows for each question that was answered.

    Turns are doubled, so that an answer comes after its question and before the next one. Of ``lines`` (conv_id, turn,
    line), those that were asked, an exit word ends its conversation here too: it gets a row of the role END.
    """
    ok = answers.where("status = 'ok'")
    two = F.array(
        F.struct((F.col("turn") * 2).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct((F.col("turn") * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    )
    said = ok.select("conv_id", F.explode(two).alias("m")).select("conv_id", "m.turn", "m.role", "m.text")
    if lines is None:
        return said
    over = lines.where(is_exit(F.col("line"))).groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return said.unionByName(over.select("conv_id", (F.col("turn") * 2).alias("turn"), F.lit(END).alias("role"), F.lit(None).cast("string").alias("text")))
