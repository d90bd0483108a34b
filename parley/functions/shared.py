"""The folder that the driver and all executors share, and what whole texts need of the session."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, beyond which it takes no further row.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a new folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder, in whatever store it is; a missing one is no error."""
    where, store = _file(spark, path)
    store.delete(where, True)


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store."""
    where, store = _file(spark, path)
    return store.exists(where)


def make_empty(spark: SparkSession, path: str) -> None:
    """An empty file, with the folders above it."""
    where, store = _file(spark, path)
    store.create(where, True).close()


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for one run. The driver removes it at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM is gone: then the cluster's own clean-up takes the folder
            pass

    atexit.register(clear)
    return path


def bound_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of about BATCH_BYTES, so that a worker's memory depends on the longest
    text and not on Spark's 10,000 rows a batch. A session that has set a bound itself keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def gathered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's rows in one partition, one after another in ``order``, for a function over partitions.

    ``repartition(key)`` alone is no such promise. Spark drops it where its input, such as a union of aggregates, is already
    dealt by the key, and then merges small partitions of the union's parts each in its own way, as a function over
    partitions demands nothing. A hash of the key is no input's partitioning.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)
