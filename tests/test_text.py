"""Expressions on queries, tools and actions."""

from pyspark.sql import functions as F

from tracemill.functions import text as X


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_domain_lists(spark):
    rows = ["['calendar']", "['crm', 'email']", "[]", None, "email", "['a', '', 'b']", "[['x']]"]
    assert values(spark, rows, X.domain_list) == [
        ["calendar"], ["customer_relationship_manager", "email"], [], [], ["email"], ["a", "b"], ["x"],
    ]


def test_only_the_first_double_underscore_becomes_a_dot(spark):
    assert values(spark, ["a__b__c", "plain", "a_b__c", "____"], X.internal_tool_id) == ["a.b__c", "plain", "a_b.c", ".__"]


def test_rendering_keeps_order_and_quotes(spark):
    args = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in [("z", 'say "hi"'), ("a", None)]])
    got = values(spark, ["email__send__now"], lambda c: X.render_action(c, args))
    assert got == ['email.send__now.func(z="say "hi"", a="None")']


def test_function_name(spark):
    assert values(spark, ['a.b.func(x="c.d(")', "a", "a.b", "a(b.c)"], X.function_name) == ["a.b", "a", "a.b", "a"]


def test_slug(spark):
    assert values(spark, ["Org/Model-7B_Instruct!", "--", "A"], X.slug) == ["org-model-7b-instruct", "", "a"]


def test_config_label(spark):
    got = values(spark, ["tool_calling", "react"], lambda c: X.config_label(F.lit("domains"), c))
    assert got == ["domains", "domains_react"]


def test_scalar_text(spark):
    assert values(spark, ["true", "false", "null", None, "1.0"], X.scalar_text) == ["True", "False", "None", "None", "1.0"]


def test_action_args(spark):
    rows = [
        'a.b.func(x="1", y="two, z=3")', "a.b.func()", 'a.b.func(x="say "hi"")', 'a.b.func(x="1", x="2")',
        'a.b.func(x="line\nbreak")', 'a.b.func(x="esc \\" quote", y="\\\\")', 'a.b.func(x="open)', 'a.b(x="1")', "",
        'a.b.func(t="), u=", v="(k="")',
    ]
    got = values(spark, rows, X.action_args)
    pairs = [None if g is None else [tuple(a) for a in g] for g in got]
    assert pairs == [
        [("x", "1"), ("y", "two, z=3")], [], None, None, None, [("x", 'esc \\" quote'), ("y", "\\\\")], None, None, None, None,
    ]


def test_long_action_text(spark):
    value = "x" * 200_000 + '\\"' * 2_000
    assert values(spark, [f'a.b.func(k="{value}")'], X.action_args)[0][0]["value"] == value


def test_stripping_follows_unicode(spark):
    assert values(spark, ["  a b \n\t", "\x1cx\x1f", "  "], X.stripped) == ["a b", "x", ""]


def test_fold_case(spark):
    m = F.create_map(*[F.lit(v) for v in ("status", "DONE", "board", "B", "list_name", "L", "name", "ANN")])
    assert values(spark, ["x"], lambda c: X.fold_state(m)) == [{"status": "DONE", "board": "B", "list_name": "L", "name": "ann"}]


def test_no_text_ends_a_job(spark):
    from tracemill.functions import jsontext as J

    odd = ['{"k": "\\ud83d"}', '{"name": "f", "arguments": {"k": "\\ud83d"}}', '{"a": ' + "9" * 5000 + "}", '{"name": "f", "arguments": "' + "[" * 5000 + '"}', '{"success": "\\udc00"}']
    for text in odd:
        for fn in (lambda t: list(J.objects_in(t)), J.verdict_in, J.calls_in, J.thoughts_in, J.name_lists_in, J.picked_ids_in):
            J.storable(fn(text))
    assert J.literal_list("[{[1]: 2}]") is None and J.literal_list("[" + "9" * 5000 + "]") is None and J.literal_list("[" * 5000) is None
    assert J.storable({"a": ["x\ud83d"]}) == {"a": ["x?"]}
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert len(df.select(J._py_objects("t"), J._py_verdict("t"), J._py_calls("t")).collect()) == len(odd)
