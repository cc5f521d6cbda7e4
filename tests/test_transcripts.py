"""Reading transcripts: the clean path and the Python path must agree with the rules."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import jsontext as J
from tracemill.functions import text as X
from tracemill.operators import datasets as D
from tracemill.operators import transcripts as T


def table(spark, texts, name="text"):
    return spark.createDataFrame(list(enumerate(texts)), f"id int, {name} string")


CALL = '{"name": "t", "arguments": {"k": "v"}}'


def block(s):
    return f"<tool_call>{s}</tool_call>"


def test_tool_calls(spark):
    cases = [
        (block(CALL) + "x" + block("\n" + CALL + "\n"), [("t", 't.func(k="v")')] * 2),
        ("Sure: " + CALL + " and " + CALL, [("t", 't.func(k="v")')]),
        (block("first " + CALL + CALL), [("t", 't.func(k="v")')]),
        (block("broken {") + block(CALL), [("t", 't.func(k="v")')]),
        # No block holds a call, so every candidate of the text counts, wrapper and inner object alike.
        (block("none") + '{"function": {"name": "t", "arguments": {}}}', [("t", "t.func()")] * 2),
        (block('{"function": {"name": "t", "arguments": {"k": "v"}}, "type": "function"}'), [("t", 't.func(k="v")')]),
        (block('{"name": "t", "parameters": {"k": 1}, "arguments": {"k": 2}}'), [("t", 't.func(k="1")')]),
        (block('{"name": "t", "arguments": "{\\"k\\": 1.50}"}'), [("t", 't.func(k="1.5")')]),
        (block('{"name": "t", "arguments": "oops"}'), []),
        (block('{"name": 3, "arguments": {}}'), []),
        (block('{"name": "t", "arguments": [1]}'), []),
        (
            block('{"name": "t", "arguments": {"a": true, "b": null, "c": [1, "x"], "d": {"e": 1}, "f": -7, "g": "true"}}'),
            [("t", "t.func(a=\"True\", b=\"None\", c=\"[1, 'x']\", d=\"{'e': 1}\", f=\"-7\", g=\"true\")")],
        ),
        (block('{"name": "a__b__c", "arguments": {"é": "ü"}}'), [("a__b__c", 'a.b__c.func(é="ü")')]),
        (block('{"name": "t", "arguments": {"k": 1, "k": 2}}'), [("t", 't.func(k="2")')]),
        (block('{"name": "t", "arguments": {"k": -0}}'), [("t", 't.func(k="0")')]),
        (block("{'name': 't', 'arguments': {}}"), []),
        ("no calls here", []),
        ("", []),
        (block('{"name":"t","arguments":{"k":12,"z":"a b"}}'), [("t", 't.func(k="12", z="a b")')]),
    ]
    got = {}
    for r in T.tool_call_table(table(spark, [c[0] for c in cases]), "text", ["id"]).orderBy("id", "step").collect():
        got.setdefault(r["id"], []).append((r["tool"], r["action"]))
    for i, (text, want) in enumerate(cases):
        assert got.get(i, []) == want, text


def test_clean_and_python_paths_agree(spark):
    texts = [block(json.dumps({"name": n, "arguments": a})) for n in ("t", "a__b") for a in (
        {}, {"k": 1}, {"z": "b", "a": "x:y, {z}"}, {"n": 10**30, "m": -5}, {"q": "it's"})]
    df = table(spark, texts)
    rows = df.select(J.tool_calls(F.col("text")).alias("a"), J._py_calls(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] and r["a"] for r in rows)


def test_json_objects(spark):
    texts = ['a {"x": {"y": {"z": 1}}} b {"q": }', "none", None, '{"s": "}{", "t": []} {1}']
    got = T.json_object_table(table(spark, texts), "text", ["id"]).orderBy("id", "ord").collect()
    assert [(r["id"], r["ord"], r["object"]) for r in got] == [
        (0, 1, '{"x": {"y": {"z": 1}}}'), (0, 2, '{"y": {"z": 1}}'), (0, 3, '{"z": 1}'), (3, 1, '{"s": "}{", "t": []}')]
    J.register(spark)
    lateral = spark.sql("SELECT id, o.* FROM {df}, LATERAL json_objects(text) o", df=table(spark, texts))
    assert sorted((r["id"], r["ord"], r["object"]) for r in lateral.collect()) == [
        (r["id"], r["ord"], r["object"]) for r in got]


def test_routing(spark):
    cases = [
        ('{"selected_tools": ["b", "a", "b", "zz"]}', ["b", "a"], True),
        ('{"selected_tools": ["zz"], "tools": "a , c"}', ["a", "c"], True),
        ('{"selected_tools": []} {"selected_tools": ["c"]}', ["c"], True),
        ('{"selected_tools": [1, "a"]} ', ["a"], True),
        ("take b then a", ["a", "b"], True),
        ("XYZ", ["a", "b", "c"], False),
        ('{"x": 1} XYZ', ["a", "b", "c"], False),
    ]
    df = table(spark, [c[0] for c in cases], "routing_text").withColumn("available", F.array(*map(F.lit, "abc")))
    got = T.routing_table(df).orderBy("id").collect()
    assert [(r["selected"], r["routed"]) for r in got] == [(c[1], c[2]) for c in cases]
    rec = T.routing_recall(T.routing_table(df).withColumn("gold_tools", F.array(F.lit("a"), F.lit("a"), F.lit("q"))))
    assert [r["recall"] for r in rec.orderBy("id").collect()][0] == 0.5


def test_thought_candidates(spark):
    good = {"id": " T1 ", "reasoning": " why ", "action": {"name": "t", "arguments": {"b": 1, "a": 2}}}
    texts = [
        json.dumps({"thoughts": [good, {"id": "T2", "final_answer": " ok "}, {"id": " "}, {"id": "T3"}, 4]}),
        json.dumps({"thoughts": [{"id": "A", "reasoning": 5, "tool_call": {"function": {"name": "u", "arguments": "{}"}}}]}),
        json.dumps({"thoughts": []}) + block(CALL),
        " just text ", "   ", None, block(CALL) + block(CALL),
    ]
    df = T.candidates(table(spark, texts, "thoughts_text").withColumnRenamed("id", "n"))
    got = {}
    for r in T.candidate_table(df, ["n"]).orderBy("n", "ord").collect():
        got.setdefault(r["n"], []).append((r["id"], r["reasoning"], r["kind"], r["tool_name"], r["tool_args"], r["final_answer"]))
    assert got == {
        0: [("T1", "why", "tool_call", "t", '{"a": 2, "b": 1}', None), ("T2", "", "final_answer", None, None, "ok")],
        1: [("A", "", "tool_call", "u", "{}", None)],
        2: [("T1", "", "tool_call", "t", '{"k": "v"}', None)],
        3: [("T1", "", "final_answer", None, None, "just text")],
        6: [("T1", "", "tool_call", "t", '{"k": "v"}', None), ("T2", "", "tool_call", "t", '{"k": "v"}', None)],
    }
    text = df.where("n = 0").select(D.candidates_text(F.col("candidates"))).first()[0]
    assert text == (
        'T1\nReasoning: why\nAction: {"arguments": {"a": 2, "b": 1}, "name": "t"}\n\n'
        "T2\nReasoning: No reasoning provided.\nFinal answer: ok")


def test_chosen_candidate(spark):
    thoughts = json.dumps({"thoughts": [{"id": i, "final_answer": "x"} for i in ("T1", "T2", "T.3")]})
    cases = [
        ('{"best_thought_id": "T2"}', "T2"), ('{"best_thought_id": "T9"} {"id": "T2"}', "T2"),
        ('{"best_thought_id": null, "selected_thought_id": "T.3"}', "T.3"), ("I pick T2, not T1", "T1"),
        ("T22 or xT1", "T1"), ("only T2!", "T2"), ("Tx3 T.3 ", "T.3"), ("", "T1"), (None, "T1"), ('{"best_thought_id": 2} T2', "T2"),
    ]
    df = spark.createDataFrame([(i, thoughts, c[0]) for i, c in enumerate(cases)], "n int, thoughts_text string, judge_text string")
    got = T.chosen_candidate(T.candidates(df)).orderBy("n").collect()
    assert [r["chosen_id"] for r in got] == [c[1] for c in cases]


def test_plans(spark):
    text = (
        "intro #E9 = no[x]\nPlan: first\n#E1 = find[{\"q\": [1, [2]]}] tail\n  Plan : second\n#E2=open [ {\"id\": \"#E1\"} ]\n"
        "Plan: broken\n#E3 = open[{\"id\": [1}\nPlan: no action here\nPlan: two\n#E4 = a[x]\n#E5 = b[y]"
    )
    got = T.plan_table(table(spark, [text, "Plan: at start\n#E1 = t[]", "no plan"]), "text", ["id"]).orderBy("id", "part").collect()
    assert [(r["id"], r["var"], r["tool_name"], r["args_template"], r["thought"]) for r in got] == [
        (0, "E1", "find", '{"q": [1, [2]]}', "first"), (0, "E2", "open", '{"id": "#E1"}', "second"),
        (0, "E4", "a", "x", "two"), (1, "E1", "t", "", "at start")]


def test_evidence(spark):
    steps = [("E1", "{}"), ("E10", '{"a": "#E1"}'), ("E1", '{"b": "#E10 #E1"}'), ("E2", '["#E1"]'), ("E3", '{"c": #E1')]
    obs = ["one", "ten #E1", "uno", "x", "y"]
    row = [(1, [(i, v, "t", a, "") for i, (v, a) in enumerate(steps)], obs)]
    kind = "id int, steps array<struct<part int, var string, tool_name string, args_template string, thought string>>, observations array<string>"
    got = T.resolved_steps(spark.createDataFrame(row, kind), ["id"]).orderBy("step").collect()
    assert [(r["resolved"], r["needs_repair"]) for r in got] == [
        ("{}", False), ('{"a": "one"}', False), ('{"b": "ten one one"}', False), ('["uno"]', True), ('{"c": uno', True)]


def test_step_cap(spark):
    steps = spark.createDataFrame([(1, i, f"E{i}", "t", "{}", "") for i in range(1, 5)],
                                  "id int, part long, var string, tool_name string, args_template string, thought string")
    for cap, n, cut in ((3, 3, True), (4, 4, False), (None, 4, False)):
        r = T.plans(steps, ["id"], cap).first()
        assert (len(r["steps"]), r["too_long"]) == (n, cut)


def test_sections(spark):
    text = (
        "=== Trial 1 of 3 ===\nReflections in buffer:\n(none)\nanswer\nEvaluator (raw):\nno Plan:\nEvaluator decision: success=False, reason=x\n"
        "Reflection appended:\ntry\nObservation:\n\nStep #E2\nThought: t"
    )
    got = T.sections(table(spark, [text, "Plan: inline", ""]), "text", ["id"]).orderBy("id", "ord").collect()
    assert [(r["id"], r["phase"], r["text"]) for r in got] == [
        (0, "trial", ""), (0, "buffer", "(none)\nanswer"), (0, "evaluator", "no Plan:"), (0, "decision", "success=False, reason=x"),
        (0, "reflection_added", "try"), (0, "observation", ""), (0, "worker_step", "Thought: t"),
        (1, "response", "Plan: inline"), (2, "response", "")]


def test_routing_sections(spark):
    text = "Routing response:\nuse a\nSelected tools: a\ncalling"
    got = T.sections(table(spark, [text]), "text", ["id"]).orderBy("ord").collect()
    assert [(r["phase"], r["text"]) for r in got] == [("routing", "use a"), ("selected_tools", "a\ncalling")]


def _objects_plainly(text):
    """A decode at every brace."""
    at, out = text.find("{"), []
    while at >= 0:
        try:
            out.append(json.JSONDecoder().raw_decode(text, at)[0])
        except (ValueError, RecursionError):
            pass
        at = text.find("{", at + 1)
    return out


def test_objects_are_those_of_a_decode_at_every_brace():
    import random

    rng = random.Random(3)
    bits = ['{', '}', '{"a": ', '"b"', ': ', '1', 'tru', 'true', ', ', '[', ']', '{"k": {"m": [1, {"n": null}]}}', '\\u00e9', '"\\u00', ' ', '\n', '"', '-', '1e5', 'x' * 40]
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randint(1, 60)))
        assert list(J.objects_in(text)) == _objects_plainly(text), text
    for edge in range(990, 1060):
        for tail in ('true}', '"\\u00e9"}', '-12.5e7}', '"y" }', '{"b": false}}', '"open', 'tru', '1'):
            text = "p " + '{"' + "k" * edge + '": ' + tail + " rest" * 3
            assert list(J.objects_in(text)) == _objects_plainly(text)
    long = json.dumps({"a": ["v" * 50_000, {"b": "\u00e9" * 9_000}]})
    assert list(J.objects_in("x\n" * 99 + long + " {")) == [json.loads(long), json.loads(long)["a"][1]]


def test_a_million_braces_take_linear_time():
    import time

    start = time.perf_counter()
    for text in ("{" * 1_000_000, '{"' * 500_000, '{"a" ' * 200_000, "{}" * 300_000):
        n = sum(1 for _ in J.objects_in(text))
        assert n == (300_000 if text.startswith("{}") else 0)
    assert time.perf_counter() - start < 60


def test_clean_thoughts_are_those_of_the_decoder(spark):
    import random

    rng = random.Random(8)
    words = ["x", " y ", "", " ", "a: b", "[z]", "it's", "name", "action", "-1", "\\\\n", '\\"', "é", "{", "}"]
    said = lambda: '"' + "".join(rng.choices(words, [9, 9, 2, 1, 3, 3, 3, 3, 3, 3, 0.3, 0.3, 0.3, 0.3, 0.3], k=rng.randint(1, 3))) + '"'
    value = lambda: rng.choice([said(), said(), "7", "-12", "0", "true", "1.5"] if rng.random() < 0.2 else [said(), "7", "-12"])

    def thought():
        args = ", ".join(f'"{rng.choice("kmname")}": {value()}' for _ in range(rng.randint(0, 3)))
        last = rng.choice([f'"action": {{"name": {said()}, "arguments": {{{args}}}}}', f'"final_answer": {said()}'])
        head = [f'"id": {said()}', f'"reasoning": {said()}']
        return "{" + ", ".join([*(head if rng.random() < 0.95 else head[::-1]), last]) + "}"

    texts = [
        rng.choice(["", "Here: ", "So [1]\n", "{} "] if rng.random() < 0.2 else ["", "Here: "]) + '{"thoughts": [' + ",\n ".join(thought() for _ in range(rng.randint(1, 4)))
        + "]}" + rng.choice(["", " done", "\n"]) for _ in range(600)
    ]
    rows = table(spark, texts).select("id", J.thoughts(F.col("text"), X.stripped).alias("t"), J.clean_thoughts(F.col("text")).alias("clean")).collect()
    for r in rows:
        want = J.thoughts_in(texts[r.id])
        if not r.clean and not want:
            continue
        got = [{k: v for k, v in c.asDict().items() if v is not None} for c in r.t]
        assert got == [{k: v for k, v in c.items() if v is not None} for c in want], texts[r.id]
    assert 150 < sum(r.clean for r in rows) < 600


def test_listed_thoughts_do_not_reach_the_decoder(spark):
    from conftest import SF
    from tracemill.plans import standins as I

    listed = I.thought_texts(spark, SF).where("thoughts_text like '%thoughts%'")
    assert listed.count() > 0 and listed.where(~J.clean_thoughts(F.col("thoughts_text"))).count() == 0


def test_turns(spark):
    acted = "A1\nObservation:\nR1\nA2\nObservation:\nR2\n"
    tree = "Thought candidates:\nc\nThought judge:\nj\nSelected thought:\ns\nObservation:\nR\nThought candidates:\nc\nFinal answer:\nx"
    df = table(spark, [acted + "Final", acted, tree, "Routing response:\nuse a\nSelected tools: a\ncalling"])
    shape = F.element_at(F.array(*map(F.lit, ("react", "react", "tree_of_thoughts", "route_then_act"))), F.col("id") + 1)
    parts = T.sections(df, "text", ["id"]).withColumns({"limited": F.col("id") == 1, "shape": shape})
    got = T.generation_cost(parts, ["id"], by=["id"], ended_on_limit="limited").orderBy("id").collect()
    assert [r["turns"] for r in got] == [3, 2, 3, 2]


def test_turns_are_told_apart_by_their_calls(spark):
    call = lambda n: f'<tool_call>{{"name": "{n}", "arguments": {{}}}}</tool_call>'
    cases = [
        # Adjacent blocks are one turn; words after a block open another.
        ("direct", f"first {call('a')}\n{call('b')}\nthen {call('c')}\nall done", [("a", 1), ("c", 2), (None, 3)]),
        ("direct", "all done", [(None, 1)]), ("direct", " \n", []),
        ("plan_then_act", f"Plan:\n- look\n{call('a')}\nok", [(None, 1), ("a", 2), (None, 3)]),
        ("plan_then_act", "Plan:\n- nothing to do", [(None, 1), (None, 2)]),
        # A comment and the reply to it are two turns, the reply's text cannot be set apart.
        ("self_reflection", f"Reflection:\nhm\n{call('a')}\nReflection:\ndone", [("a", 1), (None, 2), (None, 1), (None, 2)]),
        ("rewoo", "Plan:\nPlan: x\n#E1 = a[{}]\nStep #E1\nThought: x\nObservation:\nr\nFinal answer:\ny", [(None, 1), (None, 1)]),
        ("react", f"{call('a')} {call('b')}\nObservation:\nr\nend", [("a", 1), (None, 1)]),
        ("unknown", "text", []),
    ]
    df = table(spark, [t for _, t, _ in cases])
    shape = F.element_at(F.array(*(F.lit(s) for s, _, _ in cases)), F.col("id") + 1)
    rows = T.turn_table(T.sections(df, "text", ["id"]).withColumn("shape", shape), ["id"]).orderBy("id", "ord", "turn").collect()
    for i, (_, _, want) in enumerate(cases):
        assert [(r.tool, r.turn) for r in rows if r.id == i] == want, i
    own = [("mine", "response", False, "one")]
    assert T.turn_table(T.sections(df, "text", ["id"]).withColumn("shape", F.lit("mine")), ["id"], rules=own).where("id = 1").count() == 1


def test_trajectory_and_messages(spark):
    row = [(1, [(1, "a", '{"k": 1}', "o1"), (1, "b", "{}", "o2"), (2, "c", None, None)], "bye"), (2, [], ""), (3, [], "hi")]
    kind = "id int, actions array<struct<turn long, name string, args_json string, observation string>>, final_answer string"
    df = spark.createDataFrame(row, kind)
    t = [r[0] for r in df.orderBy("id").select(D.trajectory_text(F.col("actions"), F.col("final_answer"))).collect()]
    assert t == [
        'Step 1: a({"k": 1})\n  Observation: o1\nStep 2: b({})\n  Observation: o2\nStep 3: c({})\n  Observation: \nFinal answer: bye',
        "(no actions taken; no final answer)", "Final answer: hi"]
    msgs = df.withColumn("m", D.chat_messages(F.lit("sys"), F.lit("ask"), F.col("actions"), final_answer=F.col("final_answer")))
    rows = D.message_rows(msgs.where("id = 1"), "m", ["id"]).orderBy("ord").collect()
    assert [(r["role"], r["name"], r["content"]) for r in rows] == [
        ("system", None, "sys"), ("user", None, "ask"), ("assistant", None, None), ("tool", "a", "o1"), ("tool", "b", "o2"),
        ("assistant", None, None), ("tool", "c", None), ("assistant", None, "bye")]
    assert len(json.loads(rows[2]["tool_calls"])) == 2


@pytest.mark.parametrize(
    "text, success, reason",
    [
        ('{"success": true, "reason": " ok "}', True, "ok"),
        ('{"success": false}', False, ""),
        ('x {"a": 1} {"success": "Yes "}', True, ""),
        ('{"success": "no", "reason": [1]}', False, "[1]"),
        ('{"success": 1}', True, ""),
        ('{"success": null, "reason": "r"}', False, "r"),
        ("This was a success.", True, "This was a success."),
        ("Successfully done", True, "Successfully done"),
        ("not a success", False, "not a success"),
        ("It succeeded", False, "It succeeded"),
        (" failed ", False, "failed"),
        ('{"verdict": 1} successful', True, '{"verdict": 1} successful'),
    ],
)
def test_judge_verdict(spark, text, success, reason):
    r = table(spark, [text]).select(J.judge_verdict(F.col("text"), X.stripped).alias("v")).first()["v"]
    assert (r["success"], r["reason"]) == (success, reason)
