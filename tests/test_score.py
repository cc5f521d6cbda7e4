"""Replay and scoring on hand-written traces, one per rule."""

import pytest
from pyspark.sql import functions as F

from tracemill import constants as C
from tracemill import schemas
from tracemill.operators import reports as P
from tracemill.operators import score as S
from tracemill.sources import catalogue as K


def tool(name, kind, key="id", target="tasks"):
    return {
        "tool": f"pm__{name}", "domain": "project_management", "description": "", "params": [],
        "side_effect": kind != "read", "op_kind": kind, "target": target, "key_arg": key,
    }


@pytest.fixture(scope="module")
def tools(spark):
    return K.catalogue(
        spark,
        [tool("add", "insert", None), tool("make", "insert"), tool("set", "update"), tool("drop", "delete"), tool("find", "read"),
         tool("mail", "insert", None, "mails")],
    )


@pytest.fixture(scope="module")
def base(spark):
    rows = [("tasks", "1", {"name": "Ann", "status": "Open"}), ("tasks", "2", {"name": "bob", "status": "Open"})]
    return spark.createDataFrame(rows, schemas.BASE_STATE)


def act(fn, **kw):
    return f"pm.{fn}.func(" + ", ".join(f'{k}="{v}"' for k, v in kw.items()) + ")"


def scored(spark, tools, base, cases, **kw):
    """cases: name -> (prediction, gold[, error])."""
    names = list(cases)
    results = [("r", "d", "c", i, n, cases[n][0], "", cases[n][2] if len(cases[n]) > 2 else "") for i, n in enumerate(names)]
    gold = [(i, n, cases[n][1]) for i, n in enumerate(names)]
    r = spark.createDataFrame(results, schemas.RESULTS)
    g = spark.createDataFrame(gold, schemas.GOLD)
    out = S.score(r, g, tools, base, **kw).collect()
    return {row["query"]: row for row in out}


def test_outcomes(spark, tools, base):
    cases = {
        "same": ([act("set", id="1", status="Done")], [act("set", id="1", status="Done")]),
        "last write wins": (
            [act("set", id="1", status="A"), act("set", id="1", status="Done")], [act("set", id="1", status="Done")]),
        "no-op update": ([act("set", id="1", status="Open")], []),
        "case-only change": ([act("set", id="1", name="ANN")], []),
        "status keeps case": ([act("set", id="1", status="open")], []),
        "unknown entity": ([act("set", id="9", status="x")], []),
        "failing action does not stop the rest": (
            [act("drop", id="9"), "not an action", act("drop", id="2")], [act("drop", id="2")]),
        "update after delete": ([act("drop", id="1"), act("set", id="1", status="x")], [act("drop", id="1")]),
        "insert then delete": ([act("make", id="7", name="n"), act("drop", id="7")], []),
        "update before insert": (
            [act("set", id="7", name="early"), act("make", id="7", name="n")], [act("make", id="7", name="n")]),
        "update of an insert": (
            [act("make", id="7", name="n"), act("set", id="7", name="m")], [act("make", id="7", name="M")]),
        "insert over a known id": ([act("make", id="1", name="n")], []),
        "ids are not reused": ([act("drop", id="1"), act("make", id="1", name="n")], [act("drop", id="1")]),
        "inserts in another order": (
            [act("add", name="a"), act("add", name="b")], [act("add", name="b"), act("add", name="a")]),
        "order across targets is free": (
            [act("add", name="a"), act("mail", name="b")], [act("mail", name="b"), act("add", name="a")]),
        "surviving inserts count": (
            [act("make", id="7", name="x"), act("add", name="a"), act("drop", id="7")], [act("add", name="a")]),
        "reads change nothing": ([act("find", q="x"), act("drop", id="2")], [act("drop", id="2")]),
        "unknown tool": ([act("explode", id="1")], []),
        "quote in a value": ([act("set", id="1", name='say "hi"')], []),
        "newline in a value": ([act("set", id="1", name="a\nb")], [act("set", id="1", name="a\nb")]),
        "missing action": ([], [act("drop", id="2")]),
        "no key": (["pm.set.func(status=\"x\")"], []),
    }
    got = scored(spark, tools, base, cases)
    wrong = {n for n, r in got.items() if not r["correct"]}
    assert wrong == {"status keeps case", "inserts in another order", "missing action"}
    assert {n for n, r in got.items() if r["unwanted_side_effects"]} == {"status keeps case", "inserts in another order"}
    # A change of case alone does change the state, yet is correct when gold changes nothing.
    assert got["case-only change"]["changed"] and got["case-only change"]["correct"]


def test_errors_and_flags(spark, tools, base):
    end = act("set", id="1", due=C.GOLD_END_DATE)
    near = act("set", id="1", due=C.NEAR_END_DATE)
    start, off = act("set", id="1", at=C.GOLD_START_TIME), act("set", id="1", at="15:30:00")
    outside = act("mail", to="ann@example.com")
    cases = {
        "error": ([act("drop", id="2")], [act("drop", id="2")], C.ITERATION_LIMIT),
        "null error": ([], [], None),
        "date": ([near], [end]),
        "date other case": ([near.upper()], [end]),
        "date and more": ([near], [end, act("drop", id="2")]),
        "empty gold": ([near], []),
        "time": ([off], [start]),
        "time far": ([act("set", id="1", at="10:00:00")], [start]),
        "outside": ([outside], [act("mail", to="ann@atlas.com")]),
        "outside and own": ([outside, act("mail", to="x@atlas.com")], []),
        "outside but correct": ([outside], [outside]),
        "nothing done": ([], [act("drop", id="2")]),
        "nothing to do": (None, []),
    }
    got = scored(spark, tools, base, cases)
    flagged = lambda f: {n for n, r in got.items() if r[f]}
    # A run that stopped with an error is wrong, but without side effects if its state is right.
    assert not got["error"]["correct"] and not got["error"]["unwanted_side_effects"]
    assert got["null error"]["correct"]
    assert flagged("end_date_minor_error") == {"date"}
    assert flagged("meeting_start_time_error") == {"time"}
    assert flagged("wrong_email") == {"outside"}
    assert flagged("no_actions") == {"null error", "nothing done", "nothing to do"}
    assert got["nothing to do"]["correct"]


def test_exact_match_rules(spark, tools, base):
    drop, find = act("drop", id="2"), act("find", q="x")
    cases = {
        "reads dropped from prediction": ([find, drop], [drop]),
        "gold is not reduced": ([find, drop], [find, drop]),
        "case is ignored": ([act("set", id="1", name="ANN B")], [act("set", id="1", name="ann b")]),
        "duplicates count": ([drop, drop], [drop]),
        "any order": ([drop, act("drop", id="1")], [act("drop", id="1"), drop]),
        "argument order counts": ([act("set", id="1", name="x")], [act("set", name="x", id="1")]),
    }
    got = scored(spark, tools, base, cases)
    assert {n for n, r in got.items() if r["exact_match"]} == {
        "reads dropped from prediction", "case is ignored", "any order"}
    assert got["argument order counts"]["correct"]


def test_own_error_class_and_residue(spark, tools, base):
    cases = {"a": ([act("drop", id="1")], [act("drop", id="2")]), "b": ([act("set", id="1", status="x")], []), "c": ([], [])}
    extra = {"dropped": F.exists("prediction", lambda a: F.contains(a, F.lit("drop")))}
    got = scored(spark, tools, base, cases, error_classes=extra)
    assert [got[n]["dropped"] for n in "abc"] == [True, False, False]
    df = spark.createDataFrame(list(got.values()))
    assert {r["query"] for r in S.residual_errors(df).collect()} == {"a", "b"}
    assert {r["query"] for r in S.residual_errors(df, (*S.CAUSES, "dropped")).collect()} == {"b"}


def test_audit(spark):
    r = spark.createDataFrame([(1,), (2,), (2,), (4,)], "query_id long")
    g = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {x["query_id"]: x["problem"] for x in S.cardinality_audit(r, g, run=None).collect()}
    assert got == {2: "duplicate", 3: "no prediction", 4: "no gold"}
    with pytest.raises(ValueError):
        S.require_one_to_one(r, g, run=None)
    S.require_one_to_one(g, g, run=None)


def test_audit_by_run(spark):
    g = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    runs = g.crossJoin(spark.createDataFrame([("a",), ("b",)], "run_id string"))
    S.require_one_to_one(runs, g)
    r = runs.where("run_id = 'a' or query_id <> 3").unionByName(runs.where("run_id = 'b' and query_id = 1"))
    got = {(x["run_id"], x["query_id"]): x["problem"] for x in S.cardinality_audit(r, g).collect()}
    assert got == {("b", 1): "duplicate", ("b", 3): "no prediction"}
    assert S.cardinality_audit(runs.where("false"), g).count() == 0


def test_audit_of_odd_keys(spark):
    r = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", None), (None, 2), (None, 9)], "run_id string, query_id long")
    g = spark.createDataFrame([(1,), (2,), (2,), (None,)], "query_id long")
    got = {(x.run_id, x.query_id, x.n_predictions, x.n_gold, x.problem) for x in S.cardinality_audit(r, g).collect()}
    assert got == {
        ("a", 1, 2, 1, "duplicate"), (None, 1, 0, 1, "no prediction"), ("a", 2, 0, 2, "no prediction"), ("b", 2, 0, 2, "no prediction"),
        (None, 2, 1, 2, "duplicate"), (None, 9, 1, 0, "no gold"), ("b", None, 1, 0, "no gold"),
        ("a", None, 0, 1, "no prediction"), ("b", None, 0, 1, "no prediction"), (None, None, 0, 1, "no prediction"),
    }


def test_lookups_of_actions_without_an_id_are_spread(spark, tools, base):
    from tracemill.operators import replay as R

    acts = spark.createDataFrame([(q, s, act("make", name="x")) for q in range(20) for s in (1, 2, 3)], "query_id long, step long, action string")
    looked = R._looked_up(R.effective_writes(acts, ["query_id"], tools), base, ["query_id"])
    assert looked.count() == 60 and looked.where("in_base").count() == 0
    # Rows of a repeated prediction come back with what their trace changes.
    rows = [("r", "d", "c", 1, "q", [act("set", id="1", status="A")], "", "")] * 2 + [("r", "d", "c", 2, "q", [], "", "")]
    g = spark.createDataFrame([(1, "q", []), (2, "q", [])], schemas.GOLD)
    out = S.with_outcomes(spark.createDataFrame(rows, schemas.RESULTS), g, tools, base).collect()
    assert sorted((r.query_id, r.changed, len(r.delta)) for r in out) == [(1, True, 1), (1, True, 1), (2, False, 0)]


def test_replay_computes_nothing_in_filters(spark, tools, base):
    """A filter on a computed column is moved down by the optimiser, which then computes the column there once more."""
    from tracemill.functions import text as X
    from tracemill.operators import replay as R

    rows = [
        ("r", 1, [act("set", id="1", status="A"), "bad("]), ("r", 2, [act("find", q="z")]), ("r", 3, ['a.set.func(id="1", id="1")']),
        ("r", 4, []), ("r", 5, None), ("s", 1, [act("set", id="9", status="A")]), (None, None, [act("make", name="x")]), ("s", 6, [act("set", id="1", status="Open")]),
    ]
    runs = spark.createDataFrame(rows, "run_id string, query_id long, calls array<string>").withColumn("calls", X.escape_newlines(F.col("calls")))
    out = R.replay(R.explode_actions(runs, S.KEYS, "calls"), tools, base, S.KEYS)
    assert {(r.run_id, r.query_id, len(r.delta), r.changed) for r in out.collect()} == {("r", 1, 1, True), (None, None, 1, True), ("s", 6, 0, False)}
    plan = R.deltas(out, S.KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("lambda" in line or "RLIKE" in line)]


def test_partitioning_and_reads_do_not_matter(spark, tools, base):
    import random

    rng = random.Random(7)
    pool = [act("set", id=str(i), status=s) for i in (1, 2, 3) for s in ("A", "a", "Open")]
    pool += [act("drop", id="1"), act("make", id="7", name="n"), act("add", name="x")]
    rows = [("r", "d", "c", i, f"q{i}", rng.choices(pool, k=rng.randint(0, 5)), "", "") for i in range(60)]
    gold = [(i, f"q{i}", rng.choices(pool, k=rng.randint(0, 3))) for i in range(60)]
    noisy = [(*r[:5], [a for x in r[5] for a in (x, act("find", q="z"))], *r[6:]) for r in rows]
    g = spark.createDataFrame(gold, schemas.GOLD)
    outs = []
    for data, parts in ((rows, 1), (rows, 7), (noisy, 3)):
        df = spark.createDataFrame(data, schemas.RESULTS).repartition(parts)
        s = S.score(df, g, tools, base).select("query_id", "correct", "unwanted_side_effects")
        outs.append(sorted(map(tuple, s.collect())))
    assert outs[0] == outs[1] == outs[2]
    assert len({o[1] for o in outs[0]}) == 2

    # Against a plain replay of the same rules, row by row.
    assert outs[0] == sorted(_slow(r, g_) for r, g_ in zip(rows, gold))


def _slow(result, gold):
    import re

    def run(actions):
        state = {"1": {"name": "Ann", "status": "Open"}, "2": {"name": "bob", "status": "Open"}}
        used, added = set(state), []
        for a in actions:
            fn = a.split(".")[1]
            kw = dict(re.findall(r'(\w+)="(.*?)"', a))
            key = kw.get("id")
            if fn == "add":
                added.append((len(added), kw))
            elif fn == "make" and key not in used:
                used.add(key)
                row = dict(kw)
                added.append((len(added), row))
                state[key] = row
            elif fn == "set" and key in state:
                state[key].update({k: v for k, v in kw.items() if k != "id"})
            elif fn == "drop" and key in state:
                gone = state.pop(key)
                added = [x for x in added if x[1] is not gone]
        rows = [state.get(k) for k in ("1", "2")]
        return rows + [x[1] for x in added]

    low = lambda rows: [
        r and {k: v if k in C.CASE_KEPT_ATTRIBUTES else v.lower() for k, v in r.items()} for r in rows
    ]
    p, g, b = run(result[5]), run(gold[2]), run([])
    same = low(p) == low(g)
    return (result[3], same, p != b and not same)


def test_action_differences(spark):
    a, b = act("drop", id="1"), act("set", id="2", status="x")
    joined = spark.createDataFrame([("r", 1, [a, a, b], [a, b.upper(), b])],
                                   "run_id string, query_id long, prediction array<string>, ground_truth array<string>")
    assert {(r["action"], r["extra"], r["missing"]) for r in S.action_differences(joined).collect()} == {
        (a.lower(), 1, 0), (b.lower(), 0, 1)}


def test_near_duplicates(spark):
    f = lambda **kw: act("plot", **kw)
    calls = [f(x="1", y="2"), f(x="1", y="3"), f(x="5", y="6"), f(x="1", y="2"), f(x="1"), act("other", x="1", y="2")]
    df = spark.createDataFrame([("r", 1, calls), ("r", 2, [])], "run_id string, query_id long, function_calls array<string>")
    got = {r["function"]: (r["calls"], r["distinct_calls"], r["near_duplicates"]) for r in P.repeated_actions(df).collect()}
    assert got == {"pm.plot": (5, 4, 3), "pm.other": (1, 1, 0)}


def test_differences_cancel_before_they_are_grouped(spark):
    """What both sides hold is no row of the grouping; rows that share their keys, or have none, are added up as before."""
    rows = [
        ("a", 1, ["X", "y", "y", None], ["x", "Y", "z", None]), ("a", 1, ["z"], ["q"]), (None, None, ["x"], []), (None, None, ["x"], ["w"]),
        ("b", 2, [], []), ("b", 4, None, ["r"]), ("b", 3, ["s"] * 40, ["S"] * 40),
    ]
    df = spark.createDataFrame(rows, "run_id string, query_id long, prediction array<string>, ground_truth array<string>")
    out = S.action_differences(df)
    got = {tuple(r) for r in out.collect()}
    assert got == {("a", 1, "y", 1, 0), ("a", 1, "q", 0, 1), (None, None, "x", 2, 0), (None, None, "w", 0, 1), ("b", 4, "r", 0, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("array_union") > 0


def test_large_traces_are_dealt_into_more_parts(spark, monkeypatch, tmp_path):
    from tracemill.plans import standins as I

    ev = spark.range(4000).selectExpr("id AS event_id", "'click' AS event_type", """'{"k": 5}' AS props""")
    ev.write.parquet(f"{tmp_path}/events.parquet")
    few = I.blocks(spark, str(tmp_path), spread=True)
    monkeypatch.setattr(I, "PART_ROWS", 100)
    many = I.blocks(spark, str(tmp_path), spread=True)
    assert many.rdd.getNumPartitions() == 40 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_traces_meet_base_state_without_moving(spark, tools, base):
    """An entity that all runs of a query address is looked up once, and no trace is dealt anew for its replay."""
    from conftest import SF

    import __spark_entry__ as entry
    from tracemill.operators import replay as R

    twice = act("set", id="1", status="Done")
    rows = [(f"r{i}", "d", "c", 1, "q", [twice, act("set", id="2", status=str(i))], "", "") for i in range(4)]
    r = spark.createDataFrame(rows, schemas.RESULTS)
    known = R.lookups(S._writes(r, "function_calls", R.writing_tools(tools)), base, ["query_id"]).collect()
    assert [sorted((k.entity_id, *k.was) for k in x.known) for x in known] == [[("1", None, "Open"), ("2", None, "Open")]]
    out = S.with_outcomes(r.unionByName(r), spark.createDataFrame([(1, "q", [twice])], schemas.GOLD), tools, base.unionByName(base)).collect()
    assert len(out) == 8 and {(x.changed, x.same_outcome, len(x.delta)) for x in out} == {(True, False, 2)}
    plan = entry.queries()["scored_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan and "Window" in plan


def test_actions_that_runs_share_are_parsed_once_for_the_lookup(spark, tools, base):
    from tracemill.operators import replay as R

    a, b = act("set", id="1", status="Done"), act("set", id="2", name="x")
    lists = [(1, [a, b, None]), (1, [b, a, a]), (1, None), (2, []), (None, [a]), (None, [a])]
    r = spark.createDataFrame(lists, "query_id long, actions array<string>")
    got = {x.query_id: sorted(x.actions, key=str) for x in R.distinct_actions(r, ["query_id"], "actions").collect()}
    assert got == {1: sorted([a, b, None], key=str), 2: [], None: [a]}
    each = R.lookups(S._writes(r, "actions", R.writing_tools(tools)), base, ["query_id"]).collect()
    once = S._known(r, R.writing_tools(tools), base, ["query_id"]).collect()
    shown = lambda rows: {x.query_id: sorted(map(str, x.known)) for x in rows}
    assert shown(once) == shown(each) and len(once) == 2


def test_a_single_action_on_an_entity_is_folded_like_several(spark, tools, base):
    """Each case with and without an action more on the entity that changes nothing."""
    idle = act("set", id="1")
    known = [act("set", id="1", status="Done"), act("set", id="1", name="ANN"), act("drop", id="1"), act("make", id="1", name="n"), idle]
    new = [act("make", id="7", name="n"), act("set", id="7", name="n"), act("drop", id="7")]
    lists = [([x], [x, idle] if x != act("drop", id="1") else [idle, x]) for x in known]
    lists += [([x], [act("drop", id="7"), x]) for x in new] + [([act("add", name="N")], [act("add", name="N")])]
    rows = [("r", "d", "c", i, "q", alone, "", "") for i, (alone, _) in enumerate(lists)]
    more = [("s", "d", "c", i, "q", several, "", "") for i, (_, several) in enumerate(lists)]
    gold = spark.createDataFrame([(i, "q", alone) for i, (alone, _) in enumerate(lists)], schemas.GOLD)
    out = {(x.run_id, x.query_id): (x.delta, x.changed) for x in S.with_outcomes(spark.createDataFrame(rows + more, schemas.RESULTS), gold, tools, base).collect()}
    assert all(out["r", i] == out["s", i] for i in range(len(lists)))
    assert [x[1] for _, x in sorted(out.items())][: len(lists)] == [True, True, True, False, False, True, False, False, True]


def test_large_traces_have_as_many_parts_as_other_shuffles_start_with(spark, monkeypatch, tmp_path):
    from tracemill.plans import standins as I

    spark.range(800).selectExpr("id AS event_id", "'click' AS event_type", """'{"k": 5}' AS props""").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(I, "PART_ROWS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "30")
    try:
        assert I.blocks(spark, str(tmp_path), spread=True).rdd.getNumPartitions() == 30
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_traces_from_files_are_dealt_once(spark, tools, base, tmp_path):
    """Rows that repeat a run and a query meet, also with null keys, though rows are dealt by the query alone and before they are parsed."""
    a, b = act("set", id="1", status="Done"), act("drop", id="2")
    data = [("r", 1, [a]), ("r", 1, [b]), ("r", 1, None), ("s", 1, [a]), (None, 1, [b]), (None, 1, [b]), ("r", None, [a]), ("r", 2, [])]
    rows = [(run, "d", "c", q, "q", calls, "", "") for run, q, calls in data]
    spark.createDataFrame(rows, schemas.RESULTS).write.parquet(f"{tmp_path}/results")
    g = spark.createDataFrame([(1, "q", [a]), (2, "q", [])], schemas.GOLD)
    out = S.with_outcomes(spark.read.parquet(f"{tmp_path}/results"), g, tools, base)
    got = sorted((str(x.run_id), x.query_id, len(x.delta), x.same_outcome) for x in out.collect())
    assert got == [("", 1, 1, False)] * 2 + [("r", 1, 2, False)] * 3 + [("r", 2, 0, True), ("s", 1, 1, True)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "run_id" in line]
