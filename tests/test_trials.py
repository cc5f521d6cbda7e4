"""Choosing among trials, attempts and drafts."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import ordered as O
from tracemill.operators import datasets as D
from tracemill.operators import trials as T


def test_verifier(spark):
    cases = [
        ("VERDICT: CORRECT", True), ("so\nverdict:\n incorrect.", False), ("VERDICT: INCORRECT VERDICT: CORRECT", False),
        ("VERDICT: CORRECTLY", None), ("VERDICT CORRECT", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, verify_text string")
    assert [r["verdict"] for r in T.verifier_decisions(df).orderBy("i").collect()] == [c[1] for c in cases]


def test_choose_trial(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, False), (3, 1, None), (3, 2, False)]
    df = spark.createDataFrame(rows, "query_id int, trial int, success boolean")
    pick = lambda **kw: {r["query_id"]: (r["trial"], r["settled"]) for r in T.choose_trial(df, **kw).collect()}
    assert pick() == {1: (2, True), 2: (2, False), 3: (2, False)}
    # Limits below one act as one.
    assert pick(max_trials=0) == pick(max_trials=1) == {1: (1, False), 2: (1, False), 3: (1, False)}


def test_choose_attempt(spark):
    rows = [(1, 1, []), (1, 2, ["a"]), (1, 3, []), (2, 1, []), (2, 2, [])]
    df = spark.createDataFrame(rows, "query_id int, trial int, calls array<string>")
    pick = lambda **kw: {r["query_id"]: r["trial"] for r in T.choose_attempt(df, **kw).collect()}
    assert pick() == {1: 2, 2: 2}
    assert pick(num_retries=0) == {1: 1, 2: 1}


def test_choose_draft(spark):
    drafts = spark.createDataFrame(
        [(q, d, f"q{q}d{d}") for q in (1, 2, 3) for d in (0, 1, 2)], "query_id int, draft int, answer string")
    checks = spark.createDataFrame(
        [(1, 1, False), (1, 2, True), (2, 1, None), (2, 2, False), (3, 1, True), (3, 2, True)], "query_id int, round int, verdict boolean")
    pick = lambda **kw: {r["query_id"]: (r["answer"], r["verified"]) for r in T.choose_draft(drafts, checks, **kw).collect()}
    assert pick() == {1: ("q1d1", True), 2: ("q2d2", False), 3: ("q3d0", True)}
    assert pick(rounds=0) == pick(rounds=1) == {1: ("q1d1", False), 2: ("q2d1", False), 3: ("q3d0", True)}


@pytest.mark.parametrize("size", [0, 1, 2, 3, 50])
def test_reflection_buffer(spark, size):
    rng = random.Random(size)
    rows = [(q, t, rng.choice(["", "  ", None, f" r{t} "])) for q in range(3) for t in range(1, 30)]
    df = spark.createDataFrame(rows, "query_id int, trial int, reflection string")
    got = {(r["query_id"], r["trial"]): r["buffer"] for r in T.reflection_buffer(df, size).collect()}
    for q in range(3):
        kept = []
        for _, t, text in [r for r in rows if r[0] == q]:
            assert got[(q, t)] == (kept[-size:] if size else [])
            if text and text.strip():
                kept.append(text.strip())


def test_reflection_buffer_takes_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "a")], "query_id int, trial int, reflection string")
    plan = T.reflection_buffer(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_reflected_query(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "b array<string>")
    got = [r[0] for r in df.select(D.reflected_query(F.lit("Q"), F.col("b"))).collect()]
    assert got[0].endswith("- a\n- b\n\nUser request:\nQ") and got[1] == "Q"


def test_judge_quality(spark):
    rows = [("c", True, True), ("c", True, False), ("c", False, True), ("c", None, False), ("c", True, True), ("d", None, True)]
    df = spark.createDataFrame(rows, "config string, v boolean, t boolean")
    got = {r["config"]: r for r in T.judge_quality(df, "v", "t").collect()}
    c, d = got["c"], got["d"]
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["n_unreadable"]) == (2, 1, 1, 1, 1)
    assert c["precision"] == c["recall"] == 2 / 3
    assert d["precision"] is None and d["recall"] == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_numbers_in_ranges(spark, levels):
    rng = random.Random(1)
    rows = [(None if k == 0 else k, o) for k in range(4) for o in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "k int, o int")
    got = O.row_numbers(df, ["k"], "o", "n", width=7, levels=levels).collect()
    for k in {r["k"] for r in got}:
        mine = sorted((r["o"], r["n"]) for r in got if r["k"] == k)
        assert [n for _, n in mine] == list(range(1, 61))
