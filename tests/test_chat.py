import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley import cli
from parley.operators.models import Conversation, EchoBackend, HttpBackend, ReplayBackend, ask
from parley.plans.batch import answer
from parley.settings import Settings
from parley.streaming.chat import answer_stream


def _factory():
    """A local function, so that workers get its code and needn't import this module."""

    def make():
        return EchoBackend(fails=lambda q: q.startswith("fail"))

    return make


unreliable = _factory()


def run(lines, backend=None, prompt="rules"):
    talk = Conversation([{"role": "system", "content": prompt}])
    return talk, [o for o in (ask(talk, x, backend or unreliable()) for x in lines) if o]


@pytest.mark.parametrize(("lines", "sizes", "final"), [(["a", "b", "c"], [2, 4, 6], 7), (["a", "fail", "c"], [2, 4, 4], 5), (["fail", "fail", "c"], [2, 2, 2], 3)])
def test_history(lines, sizes, final):
    talk, out = run(lines)
    assert [o.n_messages for o in out] == sizes and len(talk.messages) == final


def test_null_answers_are_committed_and_no_choices_are_errors():
    talk, out = run(["a", "b"], ReplayBackend({"a": None}))
    assert [(o.status, o.answer) for o in out] == [("ok", None), ("error", None)]
    assert len(talk.messages) == 3 and talk.messages[-1]["content"] is None and out[1].error.startswith("IndexError")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B ", "fail", "", " ", "exit", "QUIT", "exit now"]), max_size=12))
def test_invariants(lines):
    backend = unreliable()
    talk, out = run(lines, backend)
    roles = [m["role"] for m in talk.messages]
    good = [o for o in out if o.status == "ok"]
    assert roles == ["system"] + ["user", "assistant"] * len(good)
    assert backend.calls == len(out)
    assert [m["content"] for m in talk.messages if m["role"] == "user"] == [o.question for o in good]
    assert all(o.n_messages == 2 + 2 * sum(p.status == "ok" for p in out[:i]) for i, o in enumerate(out))


TALKS = {1: ["a", "fail", "c", "", " exit ", "late"], 2: ["fail", "x"], 3: ["exit", "never"], 4: [" spaced "], 5: []}


def expected():
    return sorted((k, lines.index(next(x for x in lines if x.strip() == o.question)), o.question, o.answer, o.status, o.n_messages) for k, lines in TALKS.items() for o in run(lines)[1])


def got(frame):
    return sorted((r["conv_id"], r["turn"], r["question"], r["answer"], r["status"], r["n_messages"]) for r in frame.collect())


def test_batch(spark):
    turns = spark.createDataFrame([(k, i, x) for k, lines in TALKS.items() for i, x in enumerate(lines)], "conv_id long, turn long, line string")
    prompts = spark.createDataFrame([(k, "rules") for k in TALKS], "conv_id long, system_prompt string")
    assert got(answer(turns, unreliable, prompts)) == expected()
    bare = answer(turns, unreliable).where("conv_id = 1 and turn = 0").first()
    assert bare["n_messages"] == 1 and bare["elapsed_s"] >= 0 and bare["error"] is None


def test_batch_of_odd_rows(spark):
    """Repeated and null prompts, null turns and ids, equal turns, other columns: each question is asked once."""
    turns = [(1, None, "first"), (1, 0, "second"), (1, 2, "b"), (1, 2, "a"), (1, 5, "exit"), (1, 6, "late"), (None, 1, "y"), (None, 0, "x"), (2, 0, None), (2, 1, "alone")]
    frame = spark.createDataFrame([(*t, 0, "") for t in turns], "conv_id long, turn long, line string, kind int, system_prompt string").repartition(3)
    prompts = spark.createDataFrame([(1, "z"), (1, "rules"), (1, "rules"), (1, None), (2, None), (9, "unused")], "conv_id long, system_prompt string").repartition(3)
    rows = answer(frame, unreliable, prompts).collect()
    by_talk = {k: [(r["turn"], r["question"], r["n_messages"]) for r in rows if r["conv_id"] == k] for k in (1, 2, None)}
    assert by_talk == {1: [(None, "first", 2), (0, "second", 4), (2, "a", 6), (2, "b", 8)], 2: [(1, "alone", 1)], None: [(0, "x", 1), (1, "y", 3)]}
    assert answer(frame.limit(0), unreliable, prompts).count() == 0 and answer(frame.limit(0), unreliable).count() == 0


def _seen(folder):
    def make():
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()

        class First(EchoBackend):
            def complete(self, messages):
                return super().complete([{"content": messages[0]["content"]}])

        return First("")

    return make


def test_one_backend_for_each_worker_and_the_first_prompt(spark, tmp_path):
    turns = spark.createDataFrame([(k, i, f"q{i}") for k in range(60) for i in range(3)], "conv_id long, turn long, line string")
    prompts = spark.createDataFrame([(k, p) for k in range(60) for p in ("b", "a", "c")], "conv_id long, system_prompt string")
    rows = answer(turns.repartition(16), _seen(str(tmp_path)), prompts).collect()
    assert len(rows) == 180 and {r["answer"] for r in rows} == {"a"}
    assert 1 <= len(list(tmp_path.iterdir())) <= 4  # the session's workers


def test_one_conversation_larger_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        turns = spark.createDataFrame([(1, i, f"q{i}") for i in range(40)] + [(2, i, f"p{i}") for i in range(9)], "conv_id long, turn long, line string")
        rows = answer(turns, unreliable).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["turn"], r["n_messages"]) for r in rows if r["conv_id"] == 1] == [(i, 2 * i + 1) for i in range(40)]


def test_stream_in_and_out_of_order(spark, tmp_path):
    rows = [(k, i, x) for k, lines in TALKS.items() for i, x in enumerate(lines)]
    for part, keep in enumerate((lambda i: i % 2 == 1, lambda i: i == 0, lambda i: i and i % 2 == 0)):
        spark.createDataFrame([r for r in rows if keep(r[1])], "conv_id long, seq long, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
        lines = spark.readStream.schema("conv_id long, seq long, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "lines"))
        query = answer_stream(lines, unreliable, "rules").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert got(spark.read.parquet(str(tmp_path / "out"))) == expected()


def test_stream_keeps_null_answers_and_ignores_lines_again(spark, tmp_path):
    def recorded():
        return ReplayBackend({"a": None, "b": "yes"})

    parts = [[(1, 0, "a"), (1, 2, "b")], [(1, 0, "b"), (1, None, "b"), (None, 0, "a")], [(1, 1, None), (1, 2, "a"), (1, 3, "c")], [(1, 4, "b"), (1, 5, "exit")], [(1, 6, "b")]]
    for rows in parts:
        spark.createDataFrame(rows, "conv_id long, seq long, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
        lines = spark.readStream.schema("conv_id long, seq long, line string").parquet(str(tmp_path / "lines"))
        query = answer_stream(lines, recorded).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["turn"], r["question"], r["answer"], r["status"], r["n_messages"]) for r in rows if r["conv_id"] == 1) == [
        (0, "a", None, "ok", 1), (2, "b", "yes", "ok", 3), (3, "c", None, "error", 5), (4, "b", "yes", "ok", 5),
    ]


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, self.headers["Authorization"], body))
        if body["messages"][-1]["content"] == "fail":
            self.send_error(500)
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode())

    def log_message(self, *args):
        pass


def test_http():
    server = HTTPServer(("127.0.0.1", 0), Service)
    server.seen = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        backend = HttpBackend(Settings(api_key="k", base_url=f"http://127.0.0.1:{server.server_port}/v1"))
        _, out = run(["one", "fail", "two"], backend)
    finally:
        server.shutdown()
    assert [o.status for o in out] == ["ok", "error", "ok"] and len(server.seen) == 3  # no retries
    path, key, body = server.seen[-1]
    assert (path, key, body["temperature"], body["model"]) == ("/v1/chat/completions", "Bearer k", 0.0, Settings.model)
    assert [m["content"] for m in body["messages"]] == ["rules", "one", "yes", "two"]
    assert run(["q"], HttpBackend(Settings(api_key="k")))[1][0].status == "error"  # no address, no call


def test_cli_session():
    out, err = io.StringIO(), io.StringIO()
    talk = cli.chat("x" * 30_001, unreliable(), ["hi", "", "fail", "exit", "late"], out, err)
    assert len(talk.messages) == 3 and "30001" in out.getvalue() and "echo: hi" in out.getvalue() and "Goodbye" in out.getvalue()
    assert "[2 messages] asking ... answered after 0.00 s\necho: hi" in out.getvalue() and "[4 messages] asking ... failed" in out.getvalue()
    assert "not available" in err.getvalue() and "late" not in out.getvalue()


def test_cli_shows_that_it_asks_before_the_answer_comes():
    out = io.StringIO()

    class Looks:
        def complete(self, messages):
            assert out.getvalue().endswith("[2 messages] asking ... ")
            return {"choices": [{"message": {"content": "seen"}}]}

    cli.chat("x", Looks(), ["hi"], out, out)
    assert "seen" in out.getvalue()


def test_cli_status(spark, monkeypatch, tmp_path, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert cli.main(EchoBackend(), []) == 1
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert cli.main(EchoBackend(), []) == 1  # no sample.md here
    (tmp_path / "doc.md").write_text("text", encoding="utf-8")
    monkeypatch.setenv("MD_FILE", str(tmp_path / "doc.md"))
    assert cli.main(EchoBackend(), ["hello"]) == 0
    assert "echo: hello" in capsys.readouterr().out
