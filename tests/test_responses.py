import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from parley.operators.models import EchoBackend
from parley.operators.reports import observed, stream_figures
from parley.operators.responses import BROKEN, NO_CHOICES, NO_MESSAGE, read_responses, token_usage
from parley.plans.batch import ANSWERS, answer
from parley.streaming.chat import answer_stream

CASES = [
    ('{"choices": [{"message": {"content": "a \\" \\n é"}}, {"message": {"content": "b"}}]}', "a \" \n é", None),
    ('{"choices": [{"message": {"content": null}}]}', None, None),
    ('{"choices": [{"message": {}}]}', None, None),
    ('{"choices": [{"message": {"content": ""}}]}', "", None),
    ('{"choices": [{"message": {"content": [{"type": "text", "text": "x"}]}}]}', '[{"text":"x","type":"text"}]', None),
    ('{"choices": [{"message": {"content": 12}}]}', "12", None),
    ('{"choices": []}', None, NO_CHOICES),
    ('{"choices": null}', None, NO_CHOICES),
    ('{"error": {"message": "quota"}}', None, NO_CHOICES),
    ("[1, 2]", None, NO_CHOICES),
    ("null", None, NO_CHOICES),
    ('{"choices": [{"finish_reason": "stop"}]}', None, NO_MESSAGE),
    ('{"choices": [null]}', None, NO_CHOICES),
    ('{"choices": [{"mess', None, BROKEN),
    ("<html>", None, BROKEN),
    ("", None, BROKEN),
    (None, None, BROKEN),
]


def test_responses(spark):
    frame = spark.createDataFrame([(i, raw, "x", "y") for i, (raw, _, _) in enumerate(CASES)], "id int, response string, parsed string, Error string")
    rows = {r["id"]: r for r in read_responses(frame).collect()}
    for i, (raw, text, error) in enumerate(CASES):
        assert (rows[i]["answer"], rows[i]["error"], rows[i]["status"]) == (text, error, "error" if error else "ok"), raw
    assert read_responses(frame).columns.count("parsed") == 1 and rows[0]["parsed"] == "x"
    assert read_responses(frame.limit(0)).collect() == []


def test_token_usage(spark):
    frame = spark.createDataFrame([(json.dumps({"usage": {"prompt_tokens": 3, "total_tokens": 5}}),), ("{",), (None,)], "r string")
    assert [tuple(r[0]) for r in frame.select(token_usage(F.col("r"))).collect()] == [(3, None, 5), (None,) * 3, (None,) * 3]


def _counted(folder):
    def make():
        import uuid

        class Counting(EchoBackend):
            def complete(self, messages):
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
                return super().complete(messages)

        return Counting(fails=lambda q: q.startswith("fail"))

    return make


def figures_of(rows):
    return {"questions": len(rows), "failures": sum(r["status"] != "ok" for r in rows), "seconds": sum(r["elapsed_s"] for r in rows), "messages": sum(r["n_messages"] for r in rows)}


def close(a, b):
    return all(abs(a[k] - b[k]) < 1e-6 for k in b)


def test_a_run_reports_its_figures_without_a_second_pass(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    lines = spark.createDataFrame([(k, i, x) for k in range(5) for i, x in enumerate(["a", "fail", "", "c", "exit", "late"])], "conv_id long, turn long, line string")
    seen = Observation()
    observed(answer(lines, _counted(str(calls))), seen).write.parquet(str(tmp_path / "out"))
    rows = spark.read.schema(ANSWERS).parquet(str(tmp_path / "out")).collect()
    assert len(list(calls.iterdir())) == len(rows) == 15
    assert close(seen.get, figures_of(rows)) and seen.get["longest_s"] == max(r["elapsed_s"] for r in rows)
    nothing = Observation()
    observed(answer(lines.limit(0), _counted(str(calls))), nothing).write.format("noop").mode("overwrite").save()
    assert nothing.get == {"questions": 0, "failures": 0, "seconds": 0.0, "longest_s": 0.0, "messages": 0}


def test_a_stream_reports_its_figures(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    kind = "conv_id long, seq long, line string"
    for part in range(2):
        spark.createDataFrame([(k, i, x) for k in range(4) for i, x in enumerate(["a", "fail", "c", "d"]) if i // 2 == part], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = observed(answer_stream(lines, _counted(str(calls)))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(ANSWERS).parquet(str(tmp_path / "out")).collect()
    assert len(list(calls.iterdir())) == len(rows) == 16 and close(stream_figures(query), figures_of(rows))
