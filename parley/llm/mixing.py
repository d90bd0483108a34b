"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with ``n`` documents and the share ``w`` of the target gets the mean repetition rate ``w * total / n``.
A document's number of copies is the inverse of the Poisson distribution with that mean at a uniform number that
is seeded by its id. A mean over ``MEAN`` is the sum of equal independent parts, each inverted by itself, so no
distribution underflows. Copies then go to hash partitions and are sorted there by a hash of id and copy, which
is a random permutation of the whole result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: The largest mean that is inverted at once, and the number of terms of its distribution (beyond them: 1e-30).
MEAN, TERMS = 8, 64
#: Sources that may be broadcast with their distributions, at about 600 bytes each.
SOURCES = 20_000
ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_key")


def _uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", power: float = 0.5, size: float = 1.0) -> DataFrame:
    """(source, n, rate): documents of each source, and the mean number of copies of each.

    ``weights`` (source, weight) states the target; a source it lacks has weight 0 and goes. Without it, a
    source weighs its number of documents to the ``power``. The result holds ``size`` times the input's rows, on
    average. A null source is a source of its own (null in ``weights`` too).
    """
    counts = docs.groupBy(F.col(source).cast("string").alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), power))
    else:
        target = weights.groupBy(F.col("source").cast("string").alias("target")).agg(F.sum("weight").cast("double").alias("w"))
        weighed = counts.join(target, F.col("mix_source").eqNullSafe(F.col("target")), "left").select("mix_source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w")).first()
    share = F.col("w") / F.lit(float(sums["all_w"] or 1))
    return weighed.select("mix_source", "n", (share * float(size * (sums["all_n"] or 0)) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", power: float = 0.5, size: float = 1.0, seed: int = 17) -> DataFrame:
    """Copies of ``docs`` in random order, with ``mix_rate``, ``mix_copies``, ``mix_copy`` (from 1) and ``mix_key``.

    Every row of a source is replicated by its own Poisson count, which may be 0. The count depends on the id
    and the seed alone (without an id: on the text), so repeated rows get equal counts and a rerun gives the
    same. Null and empty texts count like others; other columns go along, whatever their names, and only those
    named as the four (in any case, as Spark compares names) are replaced; an empty table stays empty.
    """
    rates = source_rates(docs, weights, source, power, size)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN)).cast("int")
    # terms of the distribution, then running sums: P(X <= 0), P(X <= 1), ...
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-F.col("mean")).alias("term"), F.exp(-F.col("mean")).alias("sum"), F.array(F.exp(-F.col("mean"))).alias("all")),
        lambda acc, k: F.struct(
            (acc["term"] * F.col("mean") / k).alias("term"),
            (acc["sum"] + acc["term"] * F.col("mean") / k).alias("sum"),
            F.array_append(acc["all"], acc["sum"] + acc["term"] * F.col("mean") / k).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    table = rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts")).select(F.col("mix_source").alias("mix_of"), F.col("rate").alias("mix_rate"), F.col("parts").alias("mix_parts"), cdf.alias("mix_cdf"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in docs.columns else F.lit("")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.md5(text)).alias("mix_ident")
    names = [c for c in docs.columns if c.lower() not in ADDED]
    # a row's own columns lie in a struct, where their names clash with none of these
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("mix_row"), F.col(source).cast("string").alias("mix_source"), ident, F.xxhash64(text).alias("mix_text"))
    joined = own.join(
        small(table, rates.count(), SOURCES),
        F.col("mix_source").eqNullSafe(F.col("mix_of")),
    )
    copies = F.aggregate(
        F.sequence(F.lit(0), F.col("mix_parts") - 1),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter("mix_cdf", lambda c: c <= _uniform(F.concat_ws(":", "mix_ident", j.cast("string"), F.lit(str(seed)))))),
    )
    counted = joined.withColumn("mix_copies", copies).where("mix_copies > 0").select("mix_row", "mix_ident", "mix_text", "mix_rate", "mix_copies")
    exploded = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    key = F.md5(F.concat_ws(":", F.lit("order"), "mix_ident", F.col("mix_copy").cast("string"), F.lit(str(seed))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the text too, so that rows that share an id don't share a partition
    dealt = exploded.withColumn("mix_key", key).repartition(n, "mix_key", "mix_text").sortWithinPartitions("mix_key")
    return dealt.select(*(F.col(f"mix_row.`{c}`").alias(c) for c in names), *ADDED)
