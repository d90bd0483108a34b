"""What the operators of this package share: tables, scratch space, size-checked broadcasts."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import delete, run_dir

#: Rows of at most three numbers that may be broadcast; at 24 bytes each, 12 MB.
BROADCAST_ROWS = 500_000
#: Rows of one key that are joined in one place.
PART = 1000

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_go(spark: SparkSession) -> None:
    """Frees what finished plans held. Spark removes their broadcasts and shuffle files, on the executors too, once
    the driver's JVM collects the plans; a driver that has heap to spare would leave them there for long."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Parquet tables of one run in the shared folder. A written table cuts the lineage and outlives lost executors.

    ``drop`` removes a table as soon as nothing reads it; what a returned DataFrame still reads goes when the
    driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.saved = spark, run_dir(spark, "parley"), {}, 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, self.saved = f"{self.root}/{name}-{self.saved}", self.saved + 1
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes those of the tables that were saved."""
        for name in names:
            if name in self.paths:
                delete(self.spark, self.paths.pop(name))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def parts_of(counts: DataFrame, *key: str, most: int | None = None) -> DataFrame:
    """(key, parts) of the keys in ``counts`` (key, c) that have more than ``most`` rows (PART by default)."""
    most = most or PART
    return counts.where(F.col("c") > most).select(*key, F.ceil(F.col("c") / most).cast("int").alias("parts"))


def join_split(many: DataFrame, one: DataFrame, key: str | list[str], parts: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has at most a row for each key: the rows of keys in ``parts`` are split by
    the column ``by``, and their row in ``one`` is copied for each part."""
    n, key = F.coalesce("parts", F.lit(1)), [key] if isinstance(key, str) else key
    left = many.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64(by), n).cast("int")).drop("parts")
    right = one.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts")
    return left.join(right, [*key, "part"], how).drop("part")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def bounded_sample(df: DataFrame, by: str, per_class: int, seed: int, key: str = "doc_id") -> DataFrame:
    """(by, key), each pair once: at most ``per_class`` keys of each value of ``by``, those with the smallest hashes.

    Only hashes under a value's threshold are shuffled and ranked, about four times what is wanted: so a value's
    task gets as many rows however frequent the value is, and no key counts twice. Null values and keys are left out.
    """
    rows = df.select(by, key).where(F.col(by).isNotNull() & F.col(key).isNotNull()).withColumn("sample_hash", F.xxhash64(key, F.lit(seed)))
    sizes = rows.groupBy(F.col(by).alias("sample_by")).agg(F.approx_count_distinct(key).alias("sample_n"))
    place = F.col("sample_hash") / 2.0**64 + 0.5
    near = rows.join(small(sizes, sizes.count()), F.col(by) == F.col("sample_by")).where(place * F.col("sample_n") < 4.0 * per_class + 1000).select(by, key, "sample_hash").distinct()
    order = Window.partitionBy(by).orderBy("sample_hash", key)
    return near.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= per_class).select(by, key)
