"""Whole text documents as rows ``(path, content, error)``.

Paths without a scheme are read as Python's text mode does: UTF-8 strictly, ``\\r\\n`` and ``\\r`` as ``\\n``, a byte
order mark kept, an empty file as an empty text, and each failure as an error row. A few go through a Python data
source; a table of paths is scanned by the executors. Paths with a scheme are in a store that Spark reads: they go
through ``binaryFile``, folder by folder, and get the same rules from expressions. The driver never touches a single path.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import DocumentError, DocumentNotFound

SCHEMA = "path string, content string, error string"
NOT_FOUND = "not found"
#: A folder, and a name in it.
_PARENT = r"^(.*?:/*.*?)/([^/]*)/*$"
#: Bytes and files of a partition of the scan; characters of an Arrow batch; folders whose names are broadcast.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES, FEW_FOLDERS = 128 << 20, 50_000, 4 << 20, 20_000
#: Names that a store is asked for at once.
PATTERN = 200
#: A store's path: ``s3a://...``, and ``file:/...`` as Spark writes it.
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/")


class DocumentSource(DataSource):
    """``spark.read.format("document").option("paths", <JSON list>)``; ``load(path)`` reads one."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return DocumentReader(paths, int(self.options.get("perpartition", 64)))


class DocumentReader(DataSourceReader):
    def __init__(self, paths: list[str], per_partition: int):
        self.paths, self.per_partition = paths, per_partition

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.paths[i : i + self.per_partition]) for i in range(0, len(self.paths), self.per_partition)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from map(read_text, partition.value)


def read_text(path: str | None) -> tuple[str | None, str | None, str | None]:
    """(path, content, error) of one file."""
    try:
        with open(path, encoding="utf-8") as file:
            return path, file.read(), None
    except FileNotFoundError:
        return path, None, NOT_FOUND
    except Exception as e:  # noqa: BLE001  a document that fails is a row, not a failed job
        return path, None, f"{type(e).__name__}: {e}"


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, content, error) of each path, in no order; a path that is given twice gives two rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    local, remote = [p for p in paths if not _SCHEME.match(p)], [p for p in paths if _SCHEME.match(p)]
    spark.dataSource.register(DocumentSource)
    found = spark.read.format("document").option("paths", json.dumps(local)).load()
    return found.unionByName(_scan_store(spark, spark.createDataFrame([(p,) for p in remote], "path string"))) if remote else found


def scan_documents(paths: DataFrame, path: str = "path", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(path, content, error) of each row of ``paths``; a path that stands there twice gives two rows, a null one an error row.

    Paths without a scheme have to mean the same on all executors. Their sizes are looked up there first, so that files
    are dealt into partitions of about ``partition_bytes``. Of paths with a scheme, each folder is listed once, with what
    lies below it; the driver gets the folders' names, and the names of what isn't there, which it asks for by the hundred.
    """
    spark = paths.sparkSession
    asked = paths.select(F.col(path).cast("string").alias("path"))
    stored = F.coalesce(F.col("path").rlike(_SCHEME.pattern), F.lit(False))
    return _scan_local(asked.where(~stored), partition_bytes).unionByName(_scan_store(spark, asked.where(stored)))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array([_size(p) for p in batch["path"].to_pylist()], pa.int64())], ["path", "bytes"])


def _size(path: str | None) -> int:
    try:
        return os.stat(path).st_size
    except (OSError, TypeError, ValueError):  # reading it will say why
        return 0


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole files, a few megabytes of text at once."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for path in batch["path"].to_pylist():
            row = read_text(path)
            rows.append(row)
            held += len(row[1] or "")
            if held > BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.large_string()).cast(pa.string()) for i in range(3)], ["path", "content", "error"])


def _scan_local(asked: DataFrame, partition_bytes: int) -> DataFrame:
    sized = asked.mapInArrow(_sizes, "path string, bytes long")
    total = sized.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    # so many partitions that none has more than its share of bytes, or very many small files
    n = max(1, -(-(total["bytes"] or 0) // partition_bytes), -(-total["n"] // PARTITION_FILES))
    return asked.repartition(n).mapInArrow(_read_all, SCHEMA)


def _scan_store(spark: SparkSession, asked: DataFrame) -> DataFrame:
    folder, name = F.regexp_extract("path", _PARENT, 1), F.regexp_extract("path", _PARENT, 2)
    split = asked.select("path", F.regexp_replace(folder, ":$", ":/").alias("folder"), name.alias("name"))
    folders = [(r["folder"], *_qualified(spark, r["folder"])) for r in split.select("folder").distinct().toLocalIterator()]
    known = spark.createDataFrame(folders, "folder string, real string, refused string")
    wanted = split.join(F.broadcast(known) if len(folders) <= FEW_FOLDERS else known, "folder", "left").select("path", "refused", F.concat_ws("/", F.regexp_replace("real", "/$", ""), "name").alias("file"))
    real = {q for _, q, _ in folders if q}
    # a folder below another one is listed with that
    tops = [f for f in sorted(real) if not any(f"{above}/" in real or str(above) in real for above in _ancestors(f))]
    if not tops:
        return wanted.select("path", F.lit(None).cast("string").alias("content"), F.coalesce("refused", F.lit(NOT_FOUND)).alias("error"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tops)
    # folders that hold files: every ancestor of a listed file
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    index = files.select("path")  # the names alone: no content is read for them
    folders_of = index.select(F.explode(above).alias("file")).distinct().withColumn("kind", F.lit("folder"))
    kinds = index.select(F.col("path").alias("file"), F.lit("file").alias("kind")).distinct().unionByName(folders_of)
    named = wanted.join(kinds, "file", "left")
    empty = _empty(spark, named.where("kind is null and refused is null and file is not null").select("file").distinct())
    if empty:
        others = spark.createDataFrame(empty, "file string, other string")
        named = named.join(F.broadcast(others) if len(empty) <= FEW_FOLDERS else others, "file", "left").withColumn("kind", F.coalesce("kind", "other"))
    error = F.when(F.col("kind") == "folder", "IsADirectoryError: not a file").when(F.col("kind").isNull(), F.coalesce("refused", F.lit(NOT_FOUND)))
    lost = named.where("kind is null or kind <> 'file'").select("path", F.when(F.col("kind") == "empty", "").alias("content"), error.alias("error"))
    text = F.expr("try_validate_utf8(cast(content as string))")
    read = files.select(F.col("path").alias("file"), "content").join(wanted, "file")
    found = read.select("path", F.regexp_replace(text, "\r\n?", "\n").alias("content"), F.when(text.isNull(), "UnicodeDecodeError: not UTF-8").alias("error"))
    return found.unionByName(lost)


def _empty(spark: SparkSession, lost: DataFrame) -> list[tuple[str, str]]:
    """Those of the addresses that are there after all, though Spark lists no bytes for them: empty files (``empty``), and
    folders without any file (``folder``). The store is asked in patterns of PATTERN names."""
    found: list[tuple[str, str]] = []
    by_folder: dict[str, list[str]] = {}

    def ask(folder: str) -> None:
        names = by_folder.pop(folder)
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{{{','.join(re.sub(r'([^A-Za-z0-9._-])', _escaped, n) for n in names)}}}")
        for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or ():
            found.append((status.getPath().toString(), "folder" if status.isDirectory() else "empty"))

    for r in lost.toLocalIterator():
        folder, _, name = r["file"].rpartition("/")
        if name:
            by_folder.setdefault(folder, []).append(name)
            if len(by_folder[folder]) >= PATTERN:
                ask(folder)
    for folder in list(by_folder):
        ask(folder)
    return found


def _escaped(m: re.Match) -> str:
    return "\\" + m[0] if m[0] in "*?[]{}\\^," else m[0]


def _ancestors(folder: str) -> list[str]:
    parts = folder.rstrip("/").split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts))]


def _qualified(spark: SparkSession, folder: str) -> tuple[str | None, str | None]:
    """A folder's full address as Spark lists it, if it is one; or why its store refuses to say."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        return (store.makeQualified(where).toString() if store.exists(where) else None), None
    except Exception as e:  # noqa: BLE001  the documents of a folder that fails are rows, not a failed job
        cause = getattr(e, "java_exception", None)
        return None, f"{cause.getClass().getSimpleName()}: {cause.getMessage()}" if cause else f"{type(e).__name__}: {e}"


def require_document(spark: SparkSession, path: str) -> str:
    """The one document's content on the driver, for a command line; a typed error if it can't be read."""
    row = read_documents(spark, path).first()
    if row["error"] == NOT_FOUND:
        raise DocumentNotFound(path)
    if row["error"] is not None:
        raise DocumentError(row["error"])
    return row["content"]
