"""Conversations as a stream: the batch's step with its state kept by Spark between micro-batches.

Lines carry ``seq`` (from 0, without gaps, in each conversation). One that comes early waits in the state until
those before it have come, so files or records out of order change nothing.

Committed messages are a list state, to which a turn's two messages are appended; lines that wait are a map state; where
a conversation stands is one small value, which says whether the other two hold anything. So a micro-batch reads and
writes what it adds, not what there was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import AnswerLedger, ask_once
from ..operators.models import Backend, Conversation, WorkerBackend
from ..operators.transcripts import END, committed
from ..plans.batch import ANSWERS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_Answer = Row("conv_id", "turn", "question", "answer", "status", "error", "elapsed_s", "n_messages")
MISSING = "LineMissing: it did not come in time"


@dataclass
class _Place:
    """Where a conversation stands; what waits until when, in milliseconds (0: no timer)."""

    next_seq: int = 0
    ended: bool = False
    messages: int = 0
    waiting: int = 0
    gap_at: int = 0
    idle_at: int = 0
    prompt: str | None = None


_PLACE = "next_seq long, ended boolean, messages long, waiting long, gap_at long, idle_at long, prompt string"


class _Fold(StatefulProcessor):
    """One conversation's lines, in order of ``seq``, through ``ask_once``."""

    def __init__(self, backend: Callable[[], Backend], prompt: str | None, ledger: AnswerLedger | None, gap_ms: int, idle_ms: int):
        self.backend, self.prompt, self.ledger, self.gap_ms, self.idle_ms = backend, prompt, ledger, gap_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "role string, content string")
        self.waiting = handle.getMapState("waiting", "seq long", "line string")
        self.place = handle.getValueState("place", _PLACE)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        place = self._place()
        place.prompt = initialState["system_prompt"] if initialState["system_prompt"] is not None else place.prompt
        said = [(m["role"], m["content"]) for m in initialState["messages"] or []]
        place.ended = place.ended or any(role == END for role, _ in said)
        said = [m for m in said if m[0] != END and (m[0] != "system" or place.prompt is None)]
        if place.prompt is None and said and said[0][0] == "system":
            place.prompt, said = said[0][1], said[1:]
        if said and not place.ended:
            self.messages.appendList(said)
            place.messages += len(said)
        self._timers(place, timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        place = self._place()
        new: dict[int, str | None] = {}
        for row in rows:
            seq = row["seq"]
            if not place.ended and seq is not None and seq >= place.next_seq:
                new.setdefault(seq, row["line"])
        out = self._go_on(key[0], place, new) if new else []
        if new:
            self._timers(place, timerValues)
        yield from (_Answer(*o) for o in out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        place, now, out = self._place(), expiredTimerInfo.getExpiryTimeInMs(), []
        if place.idle_at and place.idle_at <= now:
            self._forget()
        elif place.gap_at and place.gap_at <= now and place.waiting:
            first = min(k[0] for k in self.waiting.keys())
            # the lines that are missing: one row each, and the conversation goes on behind them
            out = [(key[0], seq, None, None, "error", MISSING, 0.0, 0) for seq in range(place.next_seq, first)]
            place.next_seq, place.gap_at = first, 0
            out += self._go_on(key[0], place, {})
            self._timers(place, timerValues)
        yield from (_Answer(*o) for o in out)

    def _place(self) -> _Place:
        held = self.place.get()
        return _Place(*held) if held else _Place()

    def _forget(self) -> None:
        """Ends a conversation without a trace."""
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        for state in (self.messages, self.waiting, self.place):
            state.clear()

    def _timers(self, place: _Place, values) -> None:
        """Writes the place, with a timer for lines that wait for a missing one and one for silence."""
        if self.gap_ms or self.idle_ms:
            now = values.getCurrentProcessingTimeInMs()
            gap = (place.gap_at or now + self.gap_ms) if self.gap_ms and place.waiting and not place.ended else 0
            idle = now + self.idle_ms if self.idle_ms else 0
            for old, due in ((place.gap_at, gap), (place.idle_at, idle)):
                if old != due:
                    if old:
                        self.handle.deleteTimer(old)
                    if due:
                        self.handle.registerTimer(due)
            place.gap_at, place.idle_at = gap, idle
        self.place.update(astuple(place))

    def _go_on(self, conv_id: int, place: _Place, new: dict[int, str | None]) -> list[tuple]:
        early = {k[0]: v[0] for k, v in self.waiting.iterator()} if place.waiting else {}
        lines, at, out = {**new, **early}, place.next_seq, []  # what came first for a place holds
        prompt = place.prompt if place.prompt is not None else self.prompt
        talk = Conversation([{"role": "system", "content": prompt}] if prompt is not None else [])
        if at in lines and place.messages:
            talk.messages += [{"role": role, "content": content} for role, content in self.messages.get()]
        before = len(talk.messages)
        while at in lines and not talk.ended:
            o = ask_once(talk, lines.pop(at), self.backend(), self.ledger, conv_id, at)
            if o:
                out.append((conv_id, at, o.question, o.answer, o.status, o.error, o.elapsed_s, o.n_messages))
            at += 1
        if talk.ended:
            if place.messages:
                self.messages.clear()
            if early:
                self.waiting.clear()
            place.messages = place.waiting = 0
        else:
            if added := talk.messages[before:]:
                self.messages.appendList([(m["role"], m["content"]) for m in added])
                place.messages += len(added)
            for seq in early.keys() - lines.keys():
                self.waiting.removeKey((seq,))
            for seq in lines.keys() - early.keys():
                self.waiting.updateValue((seq,), (lines[seq],))
            place.waiting = len(lines)
        if at != place.next_seq:
            place.gap_at = self._drop(place.gap_at)
        place.next_seq, place.ended = at, talk.ended
        return out

    def _drop(self, timer: int) -> int:
        """A gap that has closed: what waits now waits from now on."""
        if timer:
            self.handle.deleteTimer(timer)
        return 0

    def close(self) -> None:
        pass


def answer_stream(
    lines: DataFrame, backend: Callable[[], Backend], system_prompt: str | None = None, prompts: DataFrame | None = None, history: DataFrame | None = None, ledger: AnswerLedger | None = None,
    gap_after_s: float = 0, idle_after_s: float = 0,
) -> DataFrame:
    """The batch's answers for a streaming DataFrame (conv_id, seq, line), in append mode; ``turn`` is ``seq``.

    Once a conversation has ended its state shrinks to that mark. A line that has already been taken (the same
    ``seq`` again) is ignored, as is one without ``seq``. Such state needs RocksDB as the session's state store; where the
    session has set none, it is set, and so are its changelogs, which let a batch commit its changes alone.

    A new stream goes on from ``history``, a transcript as ``answer`` takes it, which becomes its first state (each
    conversation's messages, one row of it); lines count from 0 again. ``prompts`` (conv_id, system_prompt) are first
    state too and come before ``system_prompt``, which holds for all other conversations.

    With ``gap_after_s``, a line that is missing for so long after later ones have come becomes a row of the status
    ``error``, and the conversation goes on behind it (should the line come after all, it is ignored). With
    ``idle_after_s``, a conversation to which no line has come for so long is over and leaves no state at all.
    Timers go off with micro-batches: the trigger has to run on. With a ``ledger``, a batch that is run again asks nothing twice.
    """
    spark = lines.sparkSession
    held = spark.conf.getAll
    if PROVIDER not in held:
        spark.conf.set(PROVIDER, ROCKSDB)
    if CHANGELOG not in held:  # a batch commits what it has changed, and not the store's files
        spark.conf.set(CHANGELOG, "true")
    id_ = F.col("conv_id").cast("long").alias("conv_id")
    keyed = lines.select(id_, F.col("seq").cast("long").alias("seq"), "line")
    fold = _Fold(WorkerBackend(backend), system_prompt, ledger, int(gap_after_s * 1000), int(idle_after_s * 1000))
    mode = "ProcessingTime" if gap_after_s or idle_after_s else "None"
    first = None
    if prompts is not None or history is not None:
        kind = "array<struct<role:string,content:string>>"
        said = spark.createDataFrame([], f"conv_id long, messages {kind}")
        if history is not None:
            turns = F.sort_array(F.collect_list(F.struct("turn", F.col("role"), F.col("text").alias("content"))))
            said = committed(history).groupBy(id_).agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
        seeds = spark.createDataFrame([], "conv_id long, system_prompt string")
        if prompts is not None:
            seeds = prompts.where("system_prompt is not null").groupBy(id_).agg(F.min("system_prompt").alias("system_prompt"))
        same = said["conv_id"].eqNullSafe(seeds["conv_id"])
        first = said.join(seeds, same, "full").select(F.coalesce(said["conv_id"], seeds["conv_id"]).alias("conv_id"), "system_prompt", "messages").groupBy("conv_id")
    return keyed.groupBy("conv_id").transformWithState(fold, ANSWERS, "Append", mode, first)
