"""What a run of questions did, counted by the run itself: no second pass, and no second call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NAME = "answers"


def figures() -> list[Column]:
    """Questions, failures, seconds in calls (the sum, and the longest), and messages sent."""
    failed = F.col("status") != "ok"
    return [
        F.count(F.lit(1)).alias("questions"), F.count(F.when(failed, 1)).alias("failures"), F.coalesce(F.sum("elapsed_s"), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.max("elapsed_s"), F.lit(0.0)).alias("longest_s"), F.coalesce(F.sum("n_messages"), F.lit(0)).alias("messages"),
    ]


def observed(answers: DataFrame, observation: Observation | str = NAME) -> DataFrame:
    """The same answers, whose figures the run reports: to an ``Observation`` in batch (``.get`` waits for the first action
    on them), to a stream's progress under a name."""
    return answers.observe(observation, *figures())


def stream_figures(query: StreamingQuery, name: str = NAME) -> dict[str, float]:
    """The figures of all micro-batches that the query's progress still holds, added up (``longest_s``: the longest)."""
    total: dict[str, float] = {}
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        for field, value in (row.asDict() if row else {}).items():
            total[field] = max(total.get(field, 0), value) if field == "longest_s" else total.get(field, 0) + value
    return total
