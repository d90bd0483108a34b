import random

import pytest
from pyspark.sql import functions as F

from parley.operators.transcripts import committed, conversation_arrays, first_choice, history_at_turn, outcomes, request_sizes, requests


def fold(rows):
    """Invariants, plainly: (kept rows, {turn: request}) of one conversation."""
    history, asked = [], {}
    for i, (turn, role, text) in enumerate(rows):
        after = rows[i + 1][1] if i + 1 < len(rows) else None
        if role == "user":
            asked[turn] = [(r, t) for _, r, t in history] + [(role, text)]
        if role != "user" or after == "assistant":
            history.append((turn, role, text))
    return history, asked


@pytest.fixture(scope="module")
def talks():
    rng, out = random.Random(5), {}
    for k in range(30):
        rows, turn = [], 0
        if rng.random() < 0.4:
            rows.append((turn, "system", "rules"))
        for _ in range(rng.randrange(6)):
            turn += rng.randrange(1, 3)
            rows.append((turn, "user", f"q{turn}"))
            if rng.random() < 0.6:  # else it failed, and another question may follow
                turn += 1
                rows.append((turn, "assistant", f"a{turn}" if rng.random() < 0.9 else None))
        out[k] = rows
    return out


@pytest.fixture(scope="module")
def frame(spark, talks):
    rows = [(k, *r) for k, rows in talks.items() for r in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_committed(frame, talks):
    got = sorted(tuple(r) for r in committed(frame).select("conv_id", "turn", "role").collect())
    assert got == sorted((k, t, r) for k, rows in talks.items() for t, r, _ in fold(rows)[0])


def test_requests(frame, talks):
    expected = {(k, t): m for k, rows in talks.items() for t, m in fold(rows)[1].items()}
    assert {(r["conv_id"], r["turn"]): [tuple(m) for m in r["messages"]] for r in requests(frame).collect()} == expected
    answered = {(r["conv_id"], r["turn"]) for r in outcomes(frame).where("status = 'ok'").collect()}
    assert {(r["conv_id"], r["turn"]) for r in history_at_turn(frame).collect()} == answered
    sizes = {(r["conv_id"], r["turn"]): (r["n_messages"], r["n_chars"]) for r in request_sizes(frame).collect()}
    assert sizes == {k: (len(m), sum(len(t or "") for _, t in m)) for k, m in expected.items()}


def test_no_window_is_shuffled_twice(frame):
    assert history_at_turn(frame)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_first_choice(spark):
    kind = "id int, response struct<choices: array<struct<message: struct<content: string>>>>"
    rows = [(1, {"choices": [{"message": {"content": "a"}}, {"message": {"content": "b"}}]}), (2, {"choices": []}), (3, {"choices": [{"message": {"content": None}}]})]
    frame = spark.createDataFrame(rows, kind)
    assert {r["id"]: r["c"] for r in frame.select("id", first_choice(frame["response"]).alias("c")).collect()} == {1: "a", 2: None, 3: None}


def test_a_conversation_is_held_once(frame, talks):
    """One array of messages for each conversation; a request is a slice of it."""
    rows = {r["conv_id"]: r for r in conversation_arrays(frame).collect()}
    assert rows.keys() == {k for k, lines in talks.items() if lines}
    for k, row in rows.items():
        messages, asked = fold(talks[k])
        assert [(m["role"], m["content"]) for m in row["messages"]] == [(role, text) for _, role, text in messages]
        assert {q["turn"]: q["n_before"] + 1 for q in row["asked"]} == {t: len(m) for t, m in asked.items()}


def test_requests_of_a_long_conversation(spark):
    n = 3000
    long = spark.range(2 * n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    row = requests(long).where(f"turn = {2 * n - 2}").select(F.size("messages").alias("n"), F.element_at("messages", -1)["content"].alias("last")).first()
    assert (row["n"], row["last"]) == (2 * n - 1, f"t{2 * n - 2}")
    array = conversation_arrays(long).first()
    assert len(array["messages"]) == 2 * n and len(array["asked"]) == n
