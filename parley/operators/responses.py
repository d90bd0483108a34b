"""Recorded responses as raw JSON: what a model service sent, to answers and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROKEN, NO_CHOICES, NO_MESSAGE = "BrokenResponse: not JSON", "NoChoices: the response has none", "NoMessage: the first choice has none"


def read_responses(recorded: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``status``, ``answer`` and ``error`` to rows with a JSON text, which is parsed once, as a variant.

    The first choice's content is the answer, whatever other choices there are. A null or missing content is an answer
    that is null; content in parts (an array, an object) is its JSON text. Text that isn't JSON (null and empty
    ones too), a response without choices (an error body, a null) and a choice without a message are errors. No text fails
    the job.
    """
    names = {c.lower() for c in recorded.columns}
    held = "parsed"
    while held in names:
        held = f"_{held}"
    parsed = recorded.withColumn(held, F.try_parse_json(F.col(response).cast("string")))
    at = lambda path, kind="variant": F.try_variant_get(F.col(held), path, kind)
    there = lambda part: part.isNotNull() & ~F.coalesce(F.is_variant_null(part), F.lit(True))
    error = (
        F.when(F.col(held).isNull(), BROKEN).when(~there(at("$.choices[0]")), NO_CHOICES).when(~there(at("$.choices[0].message")), NO_MESSAGE)
    )
    part = at("$.choices[0].message.content")
    text = F.coalesce(at("$.choices[0].message.content", "string"), F.when(there(part), F.to_json(part)))
    read = parsed.withColumns({"error": error, "answer": F.when(error.isNull(), text), "status": F.when(error.isNull(), "ok").otherwise("error")})
    return read.drop(held)


def token_usage(response: Column) -> Column:
    """A struct of what the service says it read and wrote, as longs; null where the response doesn't say so."""
    parsed = F.try_parse_json(response.cast("string"))
    return F.struct(*(F.try_variant_get(parsed, f"$.usage.{c}_tokens", "long").alias(c) for c in ("prompt", "completion", "total")))
