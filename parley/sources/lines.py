"""Live lines as a stream: what is typed or piped in is spooled to files, and a Python data source follows them.

A conversation's lines are one file, ``<conv_id>.lines`` in the spool folder, to which they are appended. The source gives
(conv_id, seq, line): ``seq`` counts a file's lines from 0. Its offset says for each file how many bytes and lines were
taken, so a restart goes on where the checkpoint stands, and a batch that runs again reads the same bytes.

A whole table of lines needs no file for each conversation: ``spool_shared`` writes files that conversations share, one for each
task, and ``follow_shared`` follows them, read by the executors; its offset grows with files and not with conversations.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.shared import gathered

LINES = "conv_id long, seq long, line string"
SUFFIX = ".lines"
#: Of files that conversations share.
SHARED = ".shared"
#: Rows that a task hands to Spark at once.
ROWS = 5_000
#: Bytes that are taken from one file, and from all files, in a batch.
FILE_BYTES, BATCH_BYTES = 1 << 20, 16 << 20


class LineSource(DataSource):
    """``spark.readStream.format("lines").load(folder)``; the driver reads, as it is there that people type."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return LINES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return LineReader(_plain(self.options["path"]), int(self.options.get("filebytes", FILE_BYTES)), int(self.options.get("batchbytes", BATCH_BYTES)))


class LineReader(SimpleDataSourceStreamReader):
    """Offsets: ``{file: [bytes, lines]}``. Only whole lines are taken; one without its end waits for it.

    A line longer than ``file_bytes`` is taken whole. What isn't UTF-8 is replaced; ``\\r\\n`` ends a line like ``\\n``.
    Files whose names aren't numbers are no conversations.
    """

    def __init__(self, folder: str, file_bytes: int, batch_bytes: int):
        self.folder, self.file_bytes, self.batch_bytes = Path(folder), file_bytes, batch_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end, rows, left = dict(start), [], self.batch_bytes
        files = sorted(self.folder.glob(f"*{SUFFIX}")) if self.folder.is_dir() else []
        # those of which least was taken come first, so that no file keeps the others waiting
        for file in sorted(files, key=lambda f: start.get(f.name, [0, 0])[0]):
            if left <= 0:
                break
            at, seq = start.get(file.name, [0, 0])
            size = file.stat().st_size
            if size <= at or not _number(file.name):
                continue
            with file.open("rb") as f:
                f.seek(at)
                chunk = f.read(min(self.file_bytes, size - at))
                while b"\n" not in chunk and (more := f.read(self.file_bytes)):
                    chunk += more
            whole = chunk[: chunk.rfind(b"\n") + 1]
            if whole:
                taken = _lines(file.name, whole, seq)
                rows += taken
                end[file.name] = [at + len(whole), seq + len(taken)]
                left -= len(whole)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for name, (stop, _) in sorted(end.items()):
            at, seq = start.get(name, [0, 0])
            if stop > at:
                with (self.folder / name).open("rb") as f:
                    f.seek(at)
                    yield from _lines(name, f.read(stop - at), seq)

    def commit(self, end: dict) -> None:
        pass


def _number(name: str) -> bool:
    return name.removesuffix(SUFFIX).lstrip("-").isdecimal()


def _lines(name: str, whole: bytes, seq: int) -> list[tuple]:
    conv_id = int(name.removesuffix(SUFFIX))
    return [(conv_id, seq + i, line.removesuffix(b"\r").decode("utf-8", "replace")) for i, line in enumerate(whole[:-1].split(b"\n"))]


def follow_lines(spark: SparkSession, folder: str, **options: str | int) -> DataFrame:
    """A stream (conv_id, seq, line) of what is spooled in ``folder``, from its beginning or from the query's checkpoint."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format("lines").options(**options).load(folder)


def _plain(folder: str) -> str:
    """A folder as Python opens it: drivers and executors have to mount it."""
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    if ":/" in folder:
        raise ValueError(f"lines are spooled to a mounted folder, not to {folder}")
    return folder


def _one_line(line: str | None) -> str:
    """Line ends within a line become spaces, so that a line stays one; a null one is empty."""
    return (line or "").rstrip("\r\n").replace("\r\n", " ").replace("\n", " ").replace("\r", " ") + "\n"


def _write_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Each conversation's lines, which follow one another, to its file: under another name first, then renamed."""
    now: int | None = None
    file, count, done = None, 0, []

    def close() -> None:
        if file is not None:
            file.close()
            Path(file.name).rename(Path(folder) / f"{now}{SUFFIX}")
            done.append((now, count))

    for batch in batches:
        for conv_id, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
            if file is None or conv_id != now:
                close()
                now, count = conv_id, 0
                file = (Path(folder) / f"{conv_id}.{uuid.uuid4().hex}.part").open("w", encoding="utf-8", newline="\n")
            file.write(_one_line(line))
            count += 1
    close()
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(2)], ["conv_id", "n_lines"])


def spool_table(lines: DataFrame, folder: str, order: str = "seq") -> int:
    """Writes the lines (conv_id, line) of a table to the spool folder, each conversation's whole file anew, in the given order;
    how many there were. Rows without ``conv_id`` are left out.

    The executors write. A task that runs again writes the same files. A file that is longer than it was, with the same
    beginning, is followed from where it ended.
    """
    plain = _plain(folder)
    Path(plain).mkdir(parents=True, exist_ok=True)
    rows = lines.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col(order).alias("place"), F.col("line").cast("string").alias("line"))
    written = gathered(rows, "conv_id", "place", "line").mapInArrow(lambda it: _write_files(it, plain), "conv_id long, n_lines long")
    return written.agg(F.sum("n_lines")).first()[0] or 0


def spool(folder: str, conv_id: int, lines: Iterable[str]) -> int:
    """Appends each line as it comes, and makes it visible at once; how many there were."""
    path = Path(_plain(folder))
    path.mkdir(parents=True, exist_ok=True)
    n = 0
    with (path / f"{conv_id}{SUFFIX}").open("a", encoding="utf-8", newline="\n") as file:
        for line in lines:
            file.write(_one_line(line))
            file.flush()
            n += 1
    return n


class SharedLineSource(DataSource):
    """``spark.readStream.format("shared_lines").load(folder)``, of what ``spool_shared`` has written; the executors read."""

    @classmethod
    def name(cls) -> str:
        return "shared_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return SharedLineReader(_plain(self.options["path"]))


class SharedLineReader(DataSourceStreamReader):
    """Offsets: ``{file: 1}``. A file is whole from the moment that it has its name, and isn't changed after."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {f.name: 1 for f in sorted(self.folder.glob(f"*{SHARED}"))} if self.folder.is_dir() else {}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(end.keys() - start.keys())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        with (self.folder / partition.value).open(encoding="utf-8") as file:
            for line in file:
                rows.append(json.loads(line))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "seq", "line"])


def follow_shared(spark: SparkSession, folder: str) -> DataFrame:
    """A stream (conv_id, seq, line) of what ``spool_shared`` writes to ``folder``, from its beginning or from the query's checkpoint."""
    spark.dataSource.register(SharedLineSource)
    return spark.readStream.format("shared_lines").load(folder)


def _share(batches: Iterator[pa.RecordBatch], folder: str, call: str) -> Iterator[pa.RecordBatch]:
    """A task's lines to one file, under another name first, then renamed; a task that runs again writes the same file."""
    path, n, file = Path(folder) / f"{call}-{TaskContext.get().partitionId():06d}{SHARED}", 0, None
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "seq", "line")), strict=True):
            if file is None:
                file = path.with_suffix(f".{uuid.uuid4().hex}.part").open("w", encoding="utf-8", newline="\n")
            file.write(json.dumps([*row[:2], _one_line(row[2])[:-1]], ensure_ascii=False) + "\n")
            n += 1
    if file is not None:
        file.close()
        Path(file.name).rename(path)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n_lines"])


def spool_shared(lines: DataFrame, folder: str) -> int:
    """Adds the lines (conv_id, seq, line) of a table to the spool folder, in files that conversations share; how many there were.
    Rows without ``conv_id`` are left out. A conversation's later lines go into a later call, with the ``seq`` that follows."""
    plain, call = _plain(folder), uuid.uuid4().hex
    Path(plain).mkdir(parents=True, exist_ok=True)
    rows = lines.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("line").cast("string").alias("line"))
    return rows.mapInArrow(lambda it: _share(it, plain, call), "n_lines long").agg(F.sum("n_lines")).first()[0] or 0
