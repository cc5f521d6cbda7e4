"""Gate, retrieval and few-shot choice against plain computations."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.operators import datasets as D
from tracemill.operators import episodes as E
from tracemill.operators import toolset as TS

VERBS = ["add", "set", "drop", "find"]


def make(seed, n, copies):
    """Two runs; a third of the texts may be copies of one, all texts share a hot word."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)]
    rows = []
    for seq in range(n):
        text = "the " * rng.randint(1, 3) + " ".join(rng.choices(vocab, k=rng.randint(0, 4)))
        if copies and rng.random() < 0.35:
            text = "The the w1"
        rows.append((rng.choice(["a", "a", "b"]), seq, text, rng.sample(VERBS, 2), rng.sample(VERBS, 3), rng.random() < 0.7))
    return rows


def brute(rows, k):
    out = set()
    for run in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == run]
        tf = {r[1]: Counter(w for w in re.split(r"[\W_]+", r[2].lower()) if w) for r in mine}
        store = [r for r in mine if r[5]]
        df = Counter(w for r in store for w in tf[r[1]])
        n = len(store)
        vec = {}
        for s, c in tf.items():
            w = {t: x * (math.log((1 + n) / (1 + df[t])) + 1) for t, x in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            vec[s] = {t: x / norm for t, x in w.items()}
        for q in mine:
            hits = []
            for e in store:
                if e[1] < q[1] and set(e[3]) <= set(q[4]):
                    s = round(sum(x * vec[e[1]].get(t, 0) for t, x in vec[q[1]].items()), 6)
                    if s > 0:
                        hits.append((-s, e[1]))
            out |= {(run, q[1], e, i) for i, (_, e) in enumerate(sorted(hits)[:k], 1)}
    return out


@pytest.mark.parametrize(
    "seed, copies, k, max_postings, step, max_asked",
    [
        (1, False, 3, 2000, 16, 64), (2, True, 2, 2000, 16, 5), (3, False, 3, 8, 16, 64), (4, True, 3, 3, 2, 0),
        (5, True, 1, 0, 3, 64), (6, False, 2, 1, 2, 64),
    ],
)
def test_similar_episodes_are_exact(spark, monkeypatch, seed, copies, k, max_postings, step, max_asked):
    rows = make(seed, 150, copies)
    df = spark.createDataFrame(
        rows, "run_id string, seq long, query string, tools array<string>, available array<string>, stored boolean"
    )
    monkeypatch.setattr(E, "STEP", step)
    levels = []
    postings = E._postings
    monkeypatch.setattr(E, "_postings", lambda v, f, level: levels.append(level) or postings(v, f, level))
    got = E.similar_episodes(df.where("stored"), df, k, max_postings, max_asked).collect()
    assert {(r["run_id"], r["seq"], r["e_seq"], r["rank"]) for r in got} == brute(rows, k)
    assert bool(levels) == (max_postings < 25) and (step > 3 or len(levels) > 1)


def test_salted_vocabulary_is_not_broadcast(spark):
    """Each salt has a copy of the vocabulary, of which Spark's estimate sees one: a broadcast of it would not fit the driver."""
    df = spark.createDataFrame([("a", i, f"w{i} the", i % 2 == 0) for i in range(8)], "run_id string, seq long, query string, stored boolean")
    vectors = E.text_vectors(df.where("stored"), df, 500)
    assert vectors.count() == 8 and {r["text_id"] for r in vectors.collect()} == {r[0] for r in df.select(E._text_id("query")).collect()}
    salted = [line for line in vectors._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_salt" in line]
    assert salted and all("SortMergeJoin" in line for line in salted)


@pytest.mark.parametrize("seed, copies, k, max_postings, most", [(1, False, 3, 2000, 0), (2, True, 2, 2000, 0), (4, True, 3, 3, 300), (6, False, 2, 8, 0)])
def test_blocks_give_the_same(spark, monkeypatch, seed, copies, k, max_postings, most):
    """No pair list is formed once a level has too many; blocks of a few texts give the exact result, one row a hit."""
    rows = make(seed, 150, copies)
    df = spark.createDataFrame(
        rows, "run_id string, seq long, query string, tools array<string>, available array<string>, stored boolean"
    )
    for name, n in {"MOST_PAIRS": most, "ASKED_BLOCK": 90, "STORED_BLOCK": 50}.items():
        monkeypatch.setattr(E, name, n)
    monkeypatch.setattr(E, "_postings", lambda *_: pytest.fail("a level with too many pairs was met pair by pair"))
    got = [tuple(r) for r in E.similar_episodes(df.where("stored"), df, k, max_postings).select("run_id", "seq", "e_seq", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, k)


def test_weights_that_cannot_reach_the_score_are_not_met(spark):
    """Of many episodes that share a frequent word, only those with enough weight on it are scored."""
    texts = [(i, "the " + " ".join(f"w{i}x{j}" for j in range(1 + i % 12))) for i in range(240)]
    rows = [("a", i, t, ["add"], ["add"], True) for i, t in texts] + [("a", 1000 + i, "the the", ["add"], ["add"], False) for i in range(5)]
    df = spark.createDataFrame(
        rows, "run_id string, seq long, query string, tools array<string>, available array<string>, stored boolean"
    )
    stored, k = df.where("stored"), 3
    vectors = E.text_vectors(stored, df, 10)
    first = E._earliest_copies(stored, k)
    asked = df.where("seq >= 1000").select("run_id", "seq", "available", E._text_id("query").alias("q_text"), F.lit(0.1).alias("theta"))
    met = E._met(E._wanted(asked, vectors, 2), E._postings(vectors, first, 2))
    everything = E._met(E._wanted(asked.withColumn("theta", F.lit(0.0)), vectors, 2), E._postings(vectors, first, 2))
    assert 0 < met.count() < everything.count() / 2 and everything.count() == 240
    got = {(r["seq"], r["e_seq"], r["rank"]) for r in E.similar_episodes(stored, df, k, 10).collect()}
    assert got == {(s, e, n) for _, s, e, n in brute(rows, k)}


def test_eligible_counts(spark):
    rows = make(9, 120, False)
    df = spark.createDataFrame(
        rows, "run_id string, seq long, query string, tools array<string>, available array<string>, stored boolean"
    )
    got = {(r["run_id"], r["seq"]): r["n_eligible"] for r in E.eligible_counts(df.where("stored"), df, width=10).collect()}
    for q in rows:
        n = sum(e[5] and e[0] == q[0] and e[1] < q[1] and set(e[3]) <= set(q[4]) for e in rows)
        assert got[(q[0], q[1])] == n


def test_cold_start(spark):
    df = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(10)], "run_id string, seq long, stored boolean")

    def allowed(minimum, loaded=0, width=3):
        out = E.cold_start(df, F.col("stored"), minimum, loaded, width)
        return [r["may_retrieve"] for r in out.orderBy("seq").collect()]

    assert allowed(0) == [True] * 10
    assert allowed(2) == [False] * 3 + [True] * 7
    assert allowed(2, loaded=2) == [True] * 10
    assert allowed(6) == [False] * 10


def test_gate(spark):
    rows = [("x", 1, True, 1), ("", 0, True, 1), ("", 1, False, 1), ("", 1, True, 0), ("", 1, True, 1)]
    df = spark.createDataFrame(rows, "error string, n_actions long, same_outcome boolean, n_gold long")
    assert [r["gate_status"] for r in E.gate(df).collect()] == ["error", "no actions", "incorrect", "no-op correct", "stored"]


def test_few_shot(spark):
    ex = spark.createDataFrame(
        [(["a", "b"], 5, ["t1"]), (["b", "a"], 1, ["t2"]), (["a", "b"], 2, ["t1"]), (["a"], 0, ["t1"]), (["a", "b"], 3, ["t1"])],
        "domains array<string>, pos long, tools array<string>",
    )
    q = spark.createDataFrame(
        [(1, ["a", "b"], ["t1"]), (2, ["b", "a"], ["t2", "t1"]), (3, ["a"], ["t2"]), (4, ["c"], ["t1"])],
        "query_id long, domains array<string>, available array<string>",
    )
    got = defaultdict(list)
    for r in E.few_shot(ex, q, 2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["pos"])
    assert got == {1: [2, 3], 2: [1, 2]}


def test_unknown_tools(spark):
    calls = spark.createDataFrame([(1, "a"), (1, "zz")], "query_id int, tool string")
    tools = spark.createDataFrame([("a",)], "tool string")
    assert [r["tool"] for r in TS.unknown_tools(calls, tools).collect()] == ["zz"]
    with pytest.raises(ValueError):
        TS.with_toolset(calls, "some")


def test_demonstrations_follow_rank(spark):
    picks = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "q int, e int, rank long")
    store = spark.createDataFrame(
        [(10, "ten", [(1, "t", "{}", "o")], "fin"), (11, "eleven", [], "")],
        "e int, query string, actions array<struct<turn long, name string, args_json string, observation string>>, final_answer string",
    )
    rows = D.message_rows(D.demonstrations(picks, store, ["q"], ["e"]), "prefix", ["q"]).orderBy("ord").collect()
    assert [(r["role"], r["content"]) for r in rows] == [
        ("user", "eleven"), ("user", "ten"), ("assistant", None), ("tool", "o"), ("assistant", "fin")]


def test_text_ids_are_short(spark):
    """Every entry of a vector is shuffled with the id of its text: 32 bytes, also for texts that differ in one letter."""
    df = spark.createDataFrame([("a", i, f"word {i}", ["add"], ["add"], True) for i in range(5)], "run_id string, seq long, query string, tools array<string>, available array<string>, stored boolean")
    ids = [r.text_id for r in E.text_vectors(df, df, 10).collect()]
    assert len(set(ids)) == 5 and {len(i) for i in ids} == {32}
