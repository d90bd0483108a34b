"""Conversations that go on: history, the ledger, live lines, timers and sinks."""

import io
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators.ledger import AnswerLedger
from parley.operators.models import EchoBackend
from parley.operators.transcripts import transcript_of
from parley.plans.batch import ANSWERS, answer
from parley.sources.lines import LineReader, follow_lines, follow_shared, spool, spool_shared, spool_table
from parley.streaming import chat
from parley.streaming.chat import answer_stream
from parley.streaming.sinks import both, console_sink, read_sink, table_sink

LINE = "conv_id long, turn long, line string"
TURN = "conv_id long, turn long, role string, text string"


def _echo(calls=None, dies=None):
    """Fails for questions that start with "fail"; writes a file for each call; dies for good at one question."""

    def make():
        import os
        import uuid

        class Counting(EchoBackend):
            def complete(self, messages):
                question = messages[-1]["content"]
                if dies and question == dies and os.path.exists(f"{calls}/deadly"):
                    os._exit(1)
                if calls:
                    open(f"{calls}/{question}-{uuid.uuid4().hex}", "w").close()
                return super().complete(messages)

        return Counting(fails=lambda q: q.startswith("fail"))

    return make


def asked(folder):
    return sorted(p.name.partition("-")[0] for p in folder.iterdir() if p.name != "deadly")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or ("conv_id", "turn", "question", "answer", "status", "n_messages")) for r in df.collect()), key=str)


TALKS = {1: ["a", "fail", "c", "d"], 2: ["x", "exit", "late", "later"], 3: ["fail", "", "z"], None: ["n", "m"], 4: ["only"]}


def lines_of(spark, talks, low=0, high=99):
    return spark.createDataFrame([(k, i, x) for k, lines in talks.items() for i, x in enumerate(lines) if low <= i < high], LINE)


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_a_talk_cut_in_two_is_one_talk(spark, cut):
    prompts = spark.createDataFrame([(k, f"rules {k}") for k in TALKS], "conv_id long, system_prompt string")
    whole = rows_of(answer(lines_of(spark, TALKS), _echo(), prompts))
    first = lines_of(spark, TALKS, 0, cut)
    before = answer(first, _echo(), prompts)
    after = answer(lines_of(spark, TALKS, cut), _echo(), prompts, history=transcript_of(before, first))
    assert sorted(rows_of(before) + rows_of(after), key=str) == whole


def test_prompts_meet_lines_that_share_their_partitioning(spark):
    """Windows and aggregates by conversation, in partitions of unequal sizes that Spark merges."""
    few = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "60k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    held = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        rows = spark.range(4000).select((F.col("id") % 1000).alias("conv_id"), F.floor(F.col("id") / 1000).alias("turn"), F.concat(F.lit("q"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2)).alias("line"))
        lines = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("place <= 2")
        prompts = lines.select("conv_id").distinct().select("conv_id", F.lit("rules").alias("system_prompt"))
        found = answer(lines, _echo(), prompts).groupBy("n_messages").count().collect()
        assert sorted(tuple(r) for r in found) == [(2, 1000), (4, 1000)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_history_of_odd_rows(spark):
    """A failed question leaves no trace, a recorded system message seeds, unless a prompt does; null turns come first."""
    history = spark.createDataFrame(
        [(1, 0, "system", "old"), (1, 1, "user", "lost"), (1, 2, "user", "q"), (1, 3, "assistant", None), (2, 0, "system", "old"), (2, None, "user", "p"), (2, 0, "assistant", "r"), (3, 0, "end", None), (9, 1, "user", "unused")], TURN
    )
    lines = spark.createDataFrame([(k, 0, "now") for k in (1, 2, 3, 4)], LINE)
    prompts = spark.createDataFrame([(2, "new")], "conv_id long, system_prompt string")
    assert rows_of(answer(lines, _echo(), prompts, history), "conv_id", "n_messages") == [(1, 4), (2, 3), (4, 1)]
    assert rows_of(answer(lines, _echo(), history=history.limit(0)), "conv_id", "n_messages") == [(k, 1) for k in (1, 2, 3, 4)]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_ledger_asks_once(spark, tmp_path, scheme):
    calls, ledger = tmp_path / "calls", AnswerLedger(f"{scheme}{tmp_path}/led ger")
    calls.mkdir()
    talks = {1: ["a", "fail", "c"], 2: ["b", "b", "exit", "d"], None: ["n"]}
    lines = lines_of(spark, talks).unionByName(lines_of(spark, {2: ["b"]}))  # the same line of a turn again
    backend = _echo(str(calls))
    some = rows_of(answer(lines.where("conv_id = 1"), backend, ledger=ledger))
    assert asked(calls) == ["a", "c", "fail"]
    first = rows_of(answer(lines, backend, ledger=ledger))
    assert asked(calls) == ["a", "b", "b", "b", "c", "fail", "n"] and set(some) <= set(first)
    assert ledger.compact(spark) == 7 and ledger.compact(spark) == 0
    again = answer(lines, backend, ledger=ledger)
    assert rows_of(again) == first == rows_of(again) and len(asked(calls)) == 7
    more = lines_of(spark, talks | {5: ["new"], 1: ["a", "fail", "c", "e"]}).unionByName(lines_of(spark, {2: ["b"]}))
    assert len(rows_of(answer(more, backend, ledger=ledger))) == len(first) + 2
    assert asked(calls) == ["a", "b", "b", "b", "c", "e", "fail", "n", "new"]
    rows_of(answer(lines, backend, ledger=AnswerLedger(ledger.folder, again=True)))
    assert asked(calls).count("fail") == 2 and len(asked(calls)) == 10
    assert ledger.read(spark).groupBy("conv_id", "turn", "nth", "question").count().where("count > 1").isEmpty()


def test_a_job_that_dies_asks_only_what_is_left(spark, tmp_path):
    calls, ledger = tmp_path / "calls", AnswerLedger(str(tmp_path / "ledger"))
    calls.mkdir()
    (calls / "deadly").touch()
    lines = lines_of(spark, {1: ["a", "b", "die", "c"]})
    backend = _echo(str(calls), "die")
    with pytest.raises(Exception, match="crashed|exited|Python worker|failure"):
        answer(lines, backend, ledger=ledger).collect()
    assert asked(calls) == ["a", "b"]
    (calls / "deadly").unlink()
    assert rows_of(answer(lines, backend, ledger=ledger), "question", "n_messages") == [("a", 1), ("b", 3), ("c", 7), ("die", 5)]
    assert asked(calls) == ["a", "b", "c", "die"]


def test_a_ledgers_files_dont_grow_with_the_questions(spark, tmp_path):
    calls, ledger = tmp_path / "calls", AnswerLedger(str(tmp_path / "ledger"))
    calls.mkdir()
    talks = {k: [f"{k} {i}" for i in range(30)] for k in (1, 2, None)}
    first = rows_of(answer(lines_of(spark, talks, 0, 20), _echo(str(calls)), ledger=ledger))
    files = [p for p in (tmp_path / "ledger" / "fresh").rglob("*") if p.is_file()]
    assert len(first) == 60 and len(files) == 3
    with files[0].open("ab") as file:  # a line that was cut off
        file.write(files[0].read_bytes().splitlines()[0][:-3])
    assert ledger.read(spark).count() == 60
    assert ledger.find(None, 3, "None 3", 0).n_messages == 7 and ledger.find(None, 3, "None 3", 1) is None
    rows_of(answer(lines_of(spark, talks), _echo(str(calls)), ledger=ledger))
    assert len(asked(calls)) == 90 and ledger.compact(spark) == 90 and ledger.read(spark).count() == 90


def test_an_answer_comes_before_a_recorded_failure(spark, tmp_path):
    ledger = AnswerLedger(str(tmp_path / "ledger"), again=True)
    lines = lines_of(spark, {1: ["fail"]})
    rows_of(answer(lines, _echo(), ledger=ledger))
    ledger.compact(spark)
    assert rows_of(answer(lines, EchoBackend, ledger=ledger), "status") == [("ok",)]
    assert rows_of(ledger.read(spark), "status") == [("ok",)]


def stream(spark, lines, folder, sink, **options):
    """Runs what has come so far to its end, from the checkpoint in ``folder``."""
    query = answer_stream(lines, _echo(), **options).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").start()
    query.processAllAvailable()
    return query


def test_stream_goes_on_from_history(spark, tmp_path):
    history = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 2, "user", "lost"), (2, 0, "system", "own"), (2, 1, "user", "q"), (2, 2, "assistant", "r"), (3, 0, "end", None)], TURN)
    prompts = spark.createDataFrame([(1, "rules"), (5, "other")], "conv_id long, system_prompt string")
    for k in (1, 2, 3, 4, 5):
        spool(str(tmp_path / "spool"), k, ["now", "then"])
    query = stream(spark, follow_lines(spark, str(tmp_path / "spool")), tmp_path, table_sink(str(tmp_path / "out")), system_prompt="all", prompts=prompts, history=history)
    query.stop()
    found = rows_of(read_sink(spark, str(tmp_path / "out"), ANSWERS), "conv_id", "turn", "n_messages")
    assert found == [(1, 0, 4), (1, 1, 6), (2, 0, 4), (2, 1, 6), (4, 0, 2), (4, 1, 4), (5, 0, 2), (5, 1, 4)]


def test_live_lines_after_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "spool"), str(tmp_path / "out")
    shown = io.StringIO()
    sink = both(table_sink(out), console_sink(spark, str(tmp_path / "marks"), shown, shown))
    talks = {1: ["a", "fail", "c"], 2: ["é", "exit", "late"]}
    for k, lines in talks.items():
        spool(folder, k, lines[:1])
    query = stream(spark, follow_lines(spark, folder, filebytes=4), tmp_path, sink)
    spool(folder, 1, talks[1][1:2])
    query.processAllAvailable()
    query.stop()
    for k, lines in talks.items():
        spool(folder, k, lines[2 if k == 1 else 1 :])
    with open(f"{folder}/1.lines", "a") as file:
        file.write("not yet ended")
    (tmp_path / "spool" / "notes.lines").write_text("no conversation\n")
    query = stream(spark, follow_lines(spark, folder, filebytes=4), tmp_path, sink)
    with open(f"{folder}/1.lines", "a") as file:
        file.write(" but now\n")
    query.processAllAvailable()
    query.stop()
    expected = rows_of(answer(lines_of(spark, {1: [*talks[1], "not yet ended but now"], 2: talks[2]}), _echo()))
    assert rows_of(read_sink(spark, out, ANSWERS)) == expected
    assert shown.getvalue().count("answered after") == 4 and shown.getvalue().count("failed after") == 1


def test_offsets_give_the_same_lines_again(tmp_path):
    spool(str(tmp_path), 7, ["one", "two\r\nhalf", "drei"])
    spool(str(tmp_path), -3, ["﻿x"])
    reader = LineReader(str(tmp_path), 5, 1 << 20)
    start, seen = reader.initialOffset(), []
    while True:
        rows, end = reader.read(start)
        rows = list(rows)
        assert sorted(rows) == sorted(reader.readBetweenOffsets(start, end))
        if end == start:
            break
        seen, start = seen + rows, end
    assert sorted(seen) == [(-3, 0, "﻿x"), (7, 0, "one"), (7, 1, "two half"), (7, 2, "drei")]
    assert list(LineReader(str(tmp_path / "missing"), 5, 5).read({})[0]) == []


def test_a_table_is_spooled_by_the_executors(spark, tmp_path):
    lines = spark.createDataFrame([(k, i, x) for k in range(40) for i, x in enumerate(["a\r\nb", None, f"é{k}\n"])] + [(None, 0, "left out")], "conv_id long, seq long, line string").repartition(5)
    folder = f"file://{tmp_path}/spool"
    assert spool_table(lines.where("seq < 2"), folder) == 80 and spool_table(lines, folder) == 120
    assert sorted(p.name for p in (tmp_path / "spool").iterdir()) == sorted(f"{k}.lines" for k in range(40))
    assert (tmp_path / "spool" / "7.lines").read_text(encoding="utf-8") == "a b\n\né7\n"
    assert spool_table(lines.limit(0), folder) == 0
    with pytest.raises(ValueError, match="mounted"):
        spool("store://host/x", 1, ["a"])


def test_shared_spools_after_a_restart(spark, tmp_path):
    """Files by tasks and not by conversations; what was taken before the restart isn't taken again."""
    folder, out = f"file://{tmp_path}/spool", str(tmp_path / "out")
    talks = {k: [f"a{k}", "fail", 'é "q"\r\nc\u2028\x85d', "last"] for k in range(30)} | {30: ["x", "exit", "late"], None: ["left out"]}
    lines = spark.createDataFrame([(k, i, x) for k, talk in talks.items() for i, x in enumerate(talk)], "conv_id long, seq long, line string").repartition(3)
    for part, n in ((lines.where("seq < 2"), 62), (lines.where("seq >= 2"), 61)):
        assert spool_shared(part, folder) == n
        stream(spark, follow_shared(spark, folder), tmp_path, table_sink(out)).stop()
    assert spool_shared(lines.limit(0), folder) == 0
    names = [p.name for p in (tmp_path / "spool").iterdir()]
    assert len(names) <= 6 and all(n.endswith(".shared") for n in names)
    one_line = {k: [x.replace("\r\n", " ") for x in talk] for k, talk in talks.items() if k is not None}
    assert rows_of(read_sink(spark, out, ANSWERS)) == rows_of(answer(lines_of(spark, one_line), _echo()))


def test_replayed_batches_leave_one_copy(spark, tmp_path):
    shown = io.StringIO()
    sink = both(table_sink(str(tmp_path / "out")), console_sink(spark, str(tmp_path / "marks"), shown, shown))
    batch = spark.createDataFrame([(1, 0, "q", "r", "ok", None, 0.5, 2), (1, 1, "q", None, "error", "E: x", 0.25, 4)], ANSWERS)
    for batch_id in (0, 1, 0, 1, 1):
        sink(batch.where(F.col("turn") == batch_id), batch_id)
    assert rows_of(read_sink(spark, str(tmp_path / "out"), ANSWERS), "turn", "batch_id") == [(0, 0), (1, 1)]
    assert shown.getvalue() == "[1:0] answered after 0.50 s\nr\n[1:1] failed after 0.25 s: E: x\n"


def state_rows(query):
    return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])


def test_gaps_and_idle_conversations(spark, tmp_path):
    """A missing line becomes an error row; in the end nothing is left in the state."""
    folder = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, "conv_id long, seq long, line string").coalesce(1).write.mode("append").parquet(folder)
    write([(1, 0, "a"), (1, 3, "d"), (1, 4, "e"), (2, 1, "late"), (3, 0, "fine")])
    lines = spark.readStream.schema("conv_id long, seq long, line string").parquet(folder)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 2).load().select(F.lit(-1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("seq"), F.lit("").alias("line"))
    out = str(tmp_path / "out")
    query = answer_stream(lines.unionByName(clock), _echo(), gap_after_s=2, idle_after_s=14).writeStream.foreachBatch(table_sink(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        expected = [(1, 0, "ok", 1), (1, 1, "error", 0), (1, 2, "error", 0), (1, 3, "ok", 3), (1, 4, "ok", 5), (2, 0, "error", 0), (2, 1, "ok", 1), (3, 0, "ok", 1)]
        for _ in range(240):
            time.sleep(0.5)
            found = rows_of(read_sink(spark, out, ANSWERS), "conv_id", "turn", "status", "n_messages") if (tmp_path / "out").exists() else []
            if len(found) == len(expected):
                break
        assert found == expected
        assert {r["error"] for r in read_sink(spark, out, ANSWERS).where("status = 'error'").collect()} == {chat.MISSING}
        assert state_rows(query) > 0
        for _ in range(240):
            time.sleep(0.5)
            if query.lastProgress and not state_rows(query):
                break
        assert state_rows(query) == 0
    finally:
        query.stop()


def test_transcript_of_doubles_turns(spark):
    answers = spark.createDataFrame([(1, 3, "q", "r", "ok", None, 0.0, 2), (1, 4, "q", None, "error", "x", 0.0, 4)], ANSWERS)
    assert rows_of(transcript_of(answers), "turn", "role", "text") == [(6, "user", "q"), (7, "assistant", "r")]
    assert transcript_of(answers.limit(0)).collect() == []
