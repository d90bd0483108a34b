import sys

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions.text import WHITESPACE, strip
from parley.operators.turns import normalise_turns, take_until


def kept(lines):
    """A conversation's lines as questions, plainly."""
    out = []
    for turn, line in enumerate(lines):
        text = (line or "").strip()
        if text.lower() in ("exit", "quit"):
            break
        if text:
            out.append((turn, text))
    return out


def test_white_space_is_pythons(spark):
    assert set(WHITESPACE) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}
    texts = [f"{c}a b{c}" for c in WHITESPACE] + ["​a", "﻿a", "  ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s")).collect()
    assert all(r["s"] == r["t"].strip() for r in rows)


def test_cases(spark):
    talks = {
        1: [" EXIT ", "late"], 2: ["Quit"], 3: ["exit "], 4: ["exit now", "exit​"], 5: ["", "  ", "\t", "　", "\u001c"],
        6: ["q1", "exit", "q2"], 7: ["Hello"], 8: [None, "after"],
    }
    frame = spark.createDataFrame([(k, i, x) for k, lines in talks.items() for i, x in enumerate(lines)], "conv_id long, turn long, line string")
    got = {}
    for r in normalise_turns(frame).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["line"]))
    assert got == {k: kept(v) for k, v in talks.items() if kept(v)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.one_of(st.sampled_from(["exit", " Quit", "", "\t ", "word", "EXIT it"]), st.none()), max_size=6), max_size=6))
def test_any_lines(spark, talks):
    frame = spark.createDataFrame([(k, i, x) for k, lines in enumerate(talks) for i, x in enumerate(lines)], "conv_id long, turn long, line string")
    got = sorted((r["conv_id"], r["turn"], r["line"]) for r in normalise_turns(frame).collect())
    assert got == sorted((k, t, x) for k, lines in enumerate(talks) for t, x in kept(lines))


def test_one_exchange(spark):
    plan = normalise_turns(spark.createDataFrame([(1, 1, "a")], "conv_id long, turn long, line string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_take_until_ignores_null_stops(spark):
    frame = spark.createDataFrame([(1, 0, None), (1, 1, True), (1, 2, False)], "k long, i long, s boolean")
    assert [r["i"] for r in take_until(frame, F.col("s"), "k", "i").collect()] == [0]


def test_take_until_keeps_all_columns(spark):
    frame = spark.createDataFrame([(1, 0, False, "x", "y"), (1, 1, True, "x", "y")], "k long, i long, s boolean, stopped string, _STOPPED string")
    kept_ = take_until(frame, F.col("s"), "k", "i")
    assert kept_.columns == frame.columns and [(r["stopped"], r["_STOPPED"]) for r in kept_.collect()] == [("x", "y")]
