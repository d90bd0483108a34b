"""A write-once record of answers, so that a question is asked once however often its plan runs.

Every answer is written as it comes, in a folder that all executors share. A batch deals conversations into BUCKETS and
appends a bucket's answers to one log, so that files don't grow in number with the questions. A stream, and a batch in a
store where a file is seen only when it's closed, write a file for each answer, under a name made of the conversation, the
turn, the question and how often it came before there. A retried task finds what an earlier attempt has written; a
later run reads all of it before it asks. ``compact`` moves logs and single files into Parquet between runs.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from dataclasses import asdict, dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import delete
from .models import Backend, Conversation, Outcome, ask, take

SCHEMA = "conv_id long, turn long, nth long, question string, answer string, status string, error string, elapsed_s double, n_messages long"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Logs of a run, at most; and folders that hold them. Both name files that later runs look for.
BUCKETS, FOLDERS = 4096, 64


def bucket_of(conv_id: Column) -> Column:
    """Of a conversation: the bucket whose log has its answers. ``_bucket`` is the same in Python."""
    return (F.crc32(F.coalesce(conv_id.cast("string"), F.lit("None"))) % BUCKETS).cast("int")


def _bucket(conv_id: int | None) -> int:
    return zlib.crc32(str(conv_id).encode()) % BUCKETS


def _outcome(row: dict) -> Outcome:
    return Outcome(*(row[c] for c in ("question", "answer", "status", "error", "elapsed_s", "n_messages")))


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):  # as Spark writes it, blanks and all
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@dataclass(frozen=True)
class AnswerLedger:
    """The record in ``folder``: a path or address that Spark and Arrow's file systems both reach.

    Failures are recorded too; with ``again`` they are asked anew by a later run.
    """

    folder: str
    again: bool = False

    def _name(self, conv_id: int | None, turn: int | None, question: str, nth: int) -> str:
        key = hashlib.sha256(json.dumps([conv_id, turn, question, nth]).encode()).hexdigest()[:40]
        return f"{key[:2]}/{key}.json"

    def single(self, conv_id: int | None, turn: int | None, question: str, nth: int) -> Outcome | None:
        """What a question's own file has, if there is one."""
        store, base = _store(self.folder)
        path = f"{base}/fresh/{self._name(conv_id, turn, question, nth)}"
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as file:
            return _outcome(json.loads(file.read()))

    def find(self, conv_id: int | None, turn: int | None, question: str, nth: int) -> Outcome | None:
        """What was written for a question, if it was."""
        return self.single(conv_id, turn, question, nth) or self.logged(_bucket(conv_id)).get((conv_id, turn, question, nth))

    def logged(self, bucket: int) -> dict[tuple, Outcome]:
        """What the logs of a bucket have, by (conv_id, turn, question, nth). A line that was cut off counts as not written."""
        store, base = _store(self.folder)
        found: dict[tuple, Outcome] = {}
        for info in store.get_file_info(fs.FileSelector(f"{base}/fresh/logs-{bucket % FOLDERS}", allow_not_found=True)):
            if info.base_name.startswith(f"{bucket}-"):
                with store.open_input_stream(info.path) as file:
                    for line in file.read().split(b"\n")[:-1]:
                        row = json.loads(line)
                        key = tuple(row[c] for c in ("conv_id", "turn", "question", "nth"))
                        if key not in found or found[key].status != "ok":
                            found[key] = _outcome(row)
        return found

    def log(self) -> AnswerLedger | LedgerLog:
        """What one task asks and writes through, while it goes from bucket to bucket."""
        return LedgerLog(self) if isinstance(_store(self.folder)[0], fs.LocalFileSystem) else self

    def write(self, conv_id: int | None, turn: int | None, nth: int, outcome: Outcome) -> None:
        """Writes an answer whole or not at all: under another name first, which is then changed."""
        store, base = _store(self.folder)
        path = f"{base}/fresh/{self._name(conv_id, turn, outcome.question, nth)}"
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path + ".part") as file:
            file.write(json.dumps({"conv_id": conv_id, "turn": turn, "nth": nth, **asdict(outcome)}).encode())
        store.move(path + ".part", path)

    def _fresh(self, spark: SparkSession) -> DataFrame:
        """Answers that were not moved yet, with the names of their files."""
        store, base = _store(self.folder)
        if not any(i.type == fs.FileType.Directory for i in store.get_file_info(fs.FileSelector(f"{base}/fresh", allow_not_found=True))):
            return spark.createDataFrame([], f"{SCHEMA}, file string")
        # by Spark's partition discovery, spread over the executors
        read = spark.read.schema(SCHEMA).option("pathGlobFilter", "*.{json,jsonl}").option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(f"{self.folder}/fresh")
        return read.where("question is not null").select("*", F.col("_metadata.file_path").alias("file"))  # without lines that were cut off

    def _settled(self, spark: SparkSession) -> DataFrame:
        store, base = _store(self.folder)
        if store.get_file_info(f"{base}/settled/_SUCCESS").type == fs.FileType.NotFound:
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).parquet(f"{self.folder}/settled")

    def read(self, spark: SparkSession) -> DataFrame:
        """(SCHEMA): all recorded answers, each once; a failure only where no answer came later."""
        both = self._settled(spark).unionByName(self._fresh(spark).drop("file"))
        key = ["conv_id", "turn", "nth", "question"]
        rest = F.struct(*(c for c in _FIELDS if c not in key))
        return both.groupBy(*key).agg(F.max_by(rest, F.col("status") == "ok").alias("rest")).select(*key, "rest.*").select(*_FIELDS)

    def compact(self, spark: SparkSession) -> int:
        """Moves fresh answers into Parquet, while nothing is asked; how many there were. If it's cut short, answers stand in
        both places, and count once."""
        fresh = self._fresh(spark)
        names = [r["file"] for r in fresh.select("file").limit(1).collect()]
        if not names:
            return 0
        # what is read must not be what is removed: the files are listed once, by this plan
        n = fresh.count()
        fresh.drop("file").repartition(max(1, n // 100_000)).write.mode("append").parquet(f"{self.folder}/settled")
        delete(spark, f"{self.folder}/fresh")
        return n


class LedgerLog:
    """A task's side of a ledger: one log of its own for each bucket that it comes to, a line for each answer, written through.

    ``find`` looks into the logs that earlier attempts and runs left in the bucket, which are read when it's come to.
    """

    def __init__(self, ledger: AnswerLedger):
        self.again, self._ledger, self._now, self._found, self._file = ledger.again, ledger, -1, {}, None

    def find(self, conv_id: int | None, turn: int | None, question: str, nth: int) -> Outcome | None:
        self._enter(_bucket(conv_id))
        return self._found.get((conv_id, turn, question, nth)) or self._ledger.single(conv_id, turn, question, nth)

    def write(self, conv_id: int | None, turn: int | None, nth: int, outcome: Outcome) -> None:
        self._enter(_bucket(conv_id))
        if self._file is None:
            store, base = _store(self._ledger.folder)
            folder = f"{base}/fresh/logs-{self._now % FOLDERS}"
            store.create_dir(folder, recursive=True)
            self._file = store.open_output_stream(f"{folder}/{self._now}-{uuid.uuid4().hex}.jsonl")
        self._file.write(json.dumps({"conv_id": conv_id, "turn": turn, "nth": nth, **asdict(outcome)}).encode() + b"\n")
        self._file.flush()

    def _enter(self, bucket: int) -> None:
        if bucket != self._now:
            self.close()
            self._now, self._found = bucket, self._ledger.logged(bucket)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None


def ask_once(
    conversation: Conversation, line: str | None, backend: Backend, ledger: AnswerLedger | LedgerLog | None, conv_id: int | None, turn: int | None, nth: int = 0, known: Outcome | None = None
) -> Outcome | None:
    """``ask``, but an answer that is ``known`` or in the ledger is taken from there; else it's written to the ledger.

    An answer that was recorded is committed as it was. Two attempts at once, as with speculation, may both ask.
    """
    question = (line or "").strip()
    if ledger is None or conversation.ended or not question:
        return ask(conversation, line, backend)
    found = known or ledger.find(conv_id, turn, question, nth)
    if found and not (ledger.again and found.status != "ok" and known):
        return take(conversation, found)
    outcome = ask(conversation, line, backend)
    if outcome:
        ledger.write(conv_id, turn, nth, outcome)
    return outcome
