"""Stand-in tables of agent runs, derived from the driver's tables.

A trace is a block of eight consecutive events, as an agent run is bounded by
its turn limit; so no group of these tables can grow with the data.
``oracle.py`` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import constants as C
from tracemill.sources import catalogue as K

BLOCK = 8
PART_ROWS = 100_000
DOMAINS = ("calendar", "email", "analytics", "project_management", "customer_relationship_manager")
CONFIGS = ("all", "domains", "domains_react", "domains_memory")
VERBS = ("create_item", "update_item", "delete_item", "search_items", "get_item_by_id")
EVENT_VERB = {"signup": 0, "purchase": 1, "error": 2, "click": 3, "view": 4}
KINDS = ("insert", "update", "delete", "read", "read")


# Columns used of each driver table; naming them spares a schema job per read.
TABLES = {
    "events": "event_id bigint, event_type string, props string",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def _pick(options, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def tools(spark: SparkSession) -> DataFrame:
    """Five verbs in each domain and one directory tool without parameters."""
    rows = []
    for d in DOMAINS:
        for verb, kind in zip(VERBS, KINDS):
            params = [
                {"name": "k", "type": "string", "description": "item number"},
                {"name": "date", "type": None, "description": "day"},
            ]
            rows.append(
                {
                    "tool": f"{d}__{verb}", "domain": d, "description": f"{verb} in {d}", "params": params,
                    "side_effect": kind != "read", "op_kind": kind, "target": d,
                    "key_arg": None if kind == "insert" else "k",
                }
            )
    rows.append(
        {
            "tool": "company_directory__find_email", "domain": C.DIRECTORY_DOMAIN, "description": "find an address",
            "params": [], "side_effect": False, "op_kind": "read", "target": None, "key_arg": None,
        }
    )
    return K.catalogue(spark, rows)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = F.lit(None).cast("string")
    for event, i in EVENT_VERB.items():
        verb = F.when(F.col("event_type") == event, VERBS[i]).otherwise(verb)
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.floor(F.col("event_id") / BLOCK).cast("long").alias("query_id"),
        (F.col("event_id") % BLOCK + 1).alias("step"),
        verb.alias("verb"),
        F.regexp_extract("props", r"\d+", 0).alias("k"),
    )


def _spread(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Events by trace, in as many parts as keep a part at ``PART_ROWS``.

    An event is a few bytes in a shuffle and becomes some kilobytes of actions after it, so parts by the size of the shuffle grow too large.
    Few events are left to Spark. Counting them reads the footers of the files alone.
    """
    n = load(spark, sf_dir, "events").count()
    if n <= PART_ROWS * spark.sparkContext.defaultParallelism:
        return found
    # With fewer parts than other shuffles have, a join by trace would deal the traces once more.
    others = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or others)
    return found.repartition(max(-(-n // PART_ROWS), others), "query_id")


def blocks(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``query_id, evs``: the up to eight events of each trace, in order.

    ``spread`` is for work that stays with the trace; what is dealt by trace again later would be shuffled once more.
    """
    ev = F.struct("step", "event_id", "verb", "k")
    found = events(spark, sf_dir)
    return (_spread(spark, sf_dir, found) if spread else found).groupBy("query_id").agg(F.sort_array(F.collect_list(ev)).alias("evs"))


def domain_of(query_id: Column) -> Column:
    return _pick(DOMAINS, query_id % 5)


def is_write(verb: Column) -> Column:
    return verb.isin(*VERBS[:3])


def _action(e: Column, c: Column, predicted: bool) -> Column:
    q, i, k = F.col("query_id"), e["event_id"], e["k"]
    day = F.when(q % 3 == 0, C.GOLD_END_DATE).otherwise("2023-12-01")
    time = F.lit(C.GOLD_START_TIME)
    title = F.concat(F.lit("item "), k, F.when(i % 37 == 0, F.lit("\nx")).otherwise(""))
    status = F.when(i % 2 == 0, "active").otherwise("ACTIVE")
    if predicted:
        day = F.when((day == C.GOLD_END_DATE) & (q % 7 == c), C.NEAR_END_DATE).otherwise(day)
        off = _pick(("09:00:00", "11:00:00", "15:30:00", "10:00:00"), q % 4)
        time = F.when(q % 5 == c, off).otherwise(time)
        title = (
            F.when(i % 29 == c, F.concat(F.lit("item "), k, F.lit("@example.com")))
            .when(i % 31 == c, F.concat(F.lit("item "), k, F.lit("@atlas.com")))
            .when(i % 4 == 0, F.upper(title)).otherwise(title)
        )
        status = F.when(i % 4 == 0, F.upper(status)).otherwise(status)
    tail = F.when(q % 6 == 1, F.concat(F.lit(', time="'), time, F.lit('"'))).otherwise("")
    name = F.when(
        i % 5 == 0, F.concat(F.lit(', name="CUSTOMER#'), F.lpad(k, 9, "0"), F.lit('"'))
    ).otherwise("")
    key = F.concat(F.lit('k="'), k, F.lit('"'))
    dated = F.concat(key, F.lit(', date="'), day, F.lit('"'))
    body = (
        F.when(e["verb"] == VERBS[0], F.concat(F.lit('title="'), title, F.lit('", date="'), day, F.lit('"'), tail))
        .when(e["verb"] == VERBS[1], F.concat(dated, F.lit(', status="'), status, F.lit('"'), name, tail))
        .when(e["verb"] == VERBS[2], F.concat(dated, tail)).otherwise(key)
    )
    return F.concat(domain_of(q), F.lit("."), e["verb"], F.lit(".func("), body, F.lit(")"))


def gold(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    wanted = F.filter(
        "evs", lambda e: is_write(e["verb"]) & (e["event_id"] % 17 != 0) & (F.col("query_id") % 37 != 0)
    )
    return blocks(spark, sf_dir, spread).select(
        "query_id",
        F.concat(F.lit("request "), F.col("query_id").cast("string")).alias("query"),
        F.transform(wanted, lambda e: _action(e, F.lit(0), False)).alias("answer"),
    )


def error_of(q: Column, c: Column) -> Column:
    return (
        F.when((q + c) % 23 == 0, C.ITERATION_LIMIT).when((q + c) % 47 == 0, "out of memory")
        .when(q % 3 == 0, F.lit(None)).otherwise("")
    )


def results(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Predictions of four configurations for every query."""
    runs = blocks(spark, sf_dir, spread).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "c", F.col("c").cast("long")
    )
    q, c = F.col("query_id"), F.col("c")
    kept = F.filter(
        "evs", lambda e: ((c == 0) | (e["event_id"] % (11 + c) != 0)) & ~((c == 2) & (q % 41 == 0))
    )
    return runs.select(
        _pick(CONFIGS, c).alias("run_id"), domain_of(q).alias("domain"), _pick(CONFIGS, c).alias("config"),
        "query_id", F.concat(F.lit("request "), q.cast("string")).alias("query"),
        F.transform(kept, lambda e: _action(e, c, True)).alias("function_calls"),
        F.concat(F.lit("response "), q.cast("string")).alias("full_response"),
        error_of(q, c).alias("error"),
    )


def base_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the customers, a row in each domain's table."""
    known = load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    attrs = F.create_map(
        F.lit("name"), F.col("c_name"), F.lit("status"), F.col("c_mktsegment"), F.lit("date"), F.lit("2023-12-01")
    )
    return known.select(
        F.explode(F.array(*[F.lit(d) for d in DOMAINS])).alias("target"),
        F.col("c_custkey").cast("string").alias("entity_id"), attrs.alias("attrs"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per trace, its domains still a list literal."""
    q = F.col("query_id")
    literal = (
        F.when(q % 31 == 0, "[]").when(q % 43 == 0, F.lit(None)).when(q % 7 == 0, "['crm', 'email']")
        .otherwise(F.concat(F.lit("['"), _pick((*DOMAINS[:4], "crm"), q % 5), F.lit("']")))
    )
    return events(spark, sf_dir).select("query_id").distinct().select(
        "query_id", q.alias("seq"), F.concat(F.lit("request "), q.cast("string")).alias("query"),
        literal.alias("domains"),
    )


# --- episodes, from the user turns of conversations ------------------------------------


def memory_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, seq, query, tools, available, stored`` of every user turn."""
    seq = F.col("conv_id") * 1_000_000 + F.col("turn")
    verbs = F.array(*[F.lit(v) for v in VERBS])
    return load(spark, sf_dir, "conversations").where("role = 'user'").select(
        (F.col("conv_id") % 3).alias("run_id"), seq.alias("seq"), F.col("text").alias("query"),
        F.array(_pick(VERBS, seq % 5), _pick(VERBS, (seq + 1) % 5)).alias("tools"),
        F.array_remove(verbs, _pick(VERBS, seq % 5)).alias("available"),
        (seq % 4 != 0).alias("stored"),
    )


def memory_actions(seq: Column, tools: Column) -> Column:
    """The stored calls of an episode: one per tool, each in its own turn."""
    return F.transform(
        tools,
        lambda t, i: F.struct(
            (i + 1).cast("long").alias("turn"), t.alias("name"),
            F.concat(F.lit('{"k": "'), seq.cast("string"), F.lit('"}')).alias("args_json"),
            F.lit("ok").alias("observation"),
        ),
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory_queries(spark, sf_dir)
    return m.select(
        F.array(_pick(DOMAINS, F.col("seq") % 5)).alias("domains"), F.col("seq").alias("pos"), "query", "tools",
        memory_actions(F.col("seq"), F.col("tools")).alias("actions"), F.lit("done").alias("final_answer"),
    )


# --- trials, from the assistant turns of conversations -----------------------------------

JUDGE_TEXTS = (
    '{"success": true, "reason": "ok"}',
    '{"success": false, "reason": "missing step"}',
    'Verdict: {"success": "yes", "reason": 3}',
    "It succeeded.",
    "Not a success",
    "",
    " It was successful. ",
)
VERIFIER_TEXTS = (
    "VERDICT: CORRECT",
    "verdict:  incorrect",
    "no verdict",
    "VERDICT: INCORRECT then VERDICT: CORRECT",
)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    call = F.concat(F.lit("email.search_items.func(k=\""), turn.cast("string"), F.lit('")'))
    return load(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        conv.alias("query_id"), (turn + 1).alias("trial"),
        _pick(JUDGE_TEXTS, (conv + turn) % 7).alias("judge_text"),
        _pick(VERIFIER_TEXTS, (conv + turn) % 4).alias("verify_text"),
        F.when(turn % 5 == 0, "  ").otherwise(F.col("text")).alias("reflection"),
        F.when(turn % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(call)).alias("calls"),
        _pick(CONFIGS, conv % 4).alias("config"),
    )


# --- transcripts -------------------------------------------------------------------------


def _join(parts: Column, sep: str) -> Column:
    return F.array_join(parts, sep)


def call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns in five shapes: clean blocks (twice), a nested wrapper with typed values,
    untagged objects, and arguments given as JSON text. Some blocks are broken."""
    q = F.col("query_id")
    tool = lambda e: F.concat(domain_of(q), F.lit("__"), e["verb"])
    clean = lambda e: F.concat(
        F.lit('{"name": "'), tool(e), F.lit('", "arguments": {"k": '), e["k"], F.lit(', "note": "n'),
        e["event_id"].cast("string"), F.lit('"}}'),
    )
    wrapped = lambda e: F.concat(
        F.lit('Calling {"function": {"name": "'), tool(e),
        F.lit('", "arguments": {"urgent": true, "until": null, "k": 1.0}}} now'),
    )
    as_text = lambda e: F.concat(
        F.lit('{"name": "'), tool(e), F.lit('", "parameters": "{\\"k\\": '), e["k"],
        F.lit('}", "arguments": {"k": 0}}'),
    )
    body = lambda e: F.when(
        e["event_id"] % 19 == 0, F.lit('{"name": broken')
    ).when(q % 5 == 1, wrapped(e)).when(q % 5 == 4, as_text(e)).otherwise(clean(e))
    tagged = _join(
        F.transform("evs", lambda e: F.concat(F.lit("<tool_call>"), body(e), F.lit("</tool_call>"))),
        "\nObservation:\nok\n",
    )
    plain = F.concat(F.lit("I will call "), _join(F.transform("evs", clean), " and "))
    return blocks(spark, sf_dir).select(
        "query_id", domain_of(q).alias("domain"), F.when(q % 5 == 3, plain).otherwise(tagged).alias("text")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full responses with phase marks: two trials when q is even, routing when it
    is 3 modulo 4, the events as observations or reflections."""
    q = F.col("query_id")
    part = lambda e: F.concat(
        F.when(is_write(e["verb"]), "Observation:\nok ").otherwise("Reflection:\nnote "), e["event_id"].cast("string")
    )
    trial = lambda i: F.lit(f"=== Trial {i} of 2 ===\nReflections in buffer:\n(none)\ncalling\nit\n")
    routed = F.lit("Routing response:\nuse both\nSelected tools: a, b\nthinking\n")
    head = F.when(q % 2 == 0, F.concat(trial(1), trial(2))).when(q % 4 == 3, routed).otherwise(F.lit("thinking\n"))
    full = F.concat(
        head, F.lit("Plan:\n- look up first\n"), _join(F.transform("evs", part), "\n"), F.lit("\nFinal answer:\ndone")
    )
    return blocks(spark, sf_dir).select(
        "query_id", _pick(CONFIGS, q % 4).alias("config"), full.alias("full_response")
    )


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of up to sixteen steps (two per event) in which #E10 and #E1 meet."""
    step = lambda e: F.concat(
        F.lit("Plan: find "), e["event_id"].cast("string"), F.lit("\n#E"), (e["step"] * 2 - 1).cast("string"),
        F.lit(" = "), e["verb"], F.lit('[{"k": "'), e["k"], F.lit('"}]\nPlan: use it\n#E'),
        (e["step"] * 2).cast("string"), F.lit(" = "),
        F.when(e["event_id"] % 6 == 0, F.lit('list_all[{"ids": ["#E1", "#E10"], "n": #E1}]'))
        .when(e["event_id"] % 6 == 1, F.lit('open_one[{"id": "#E1"'))
        .otherwise(F.lit('open_one[{"id": "#E10 #E1"}]')),
    )
    return blocks(spark, sf_dir).select(
        "query_id", F.concat(F.lit("My plan.\n"), _join(F.transform("evs", step), "\n")).alias("text")
    )


def thought_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion texts in four shapes, with a judge's text: the listed form, a bare call, prose, blank."""
    q = F.col("query_id")
    thought = lambda e: F.concat(
        F.lit('{"id": "T'), e["step"].cast("string"), F.lit('", "reasoning": " because '), e["k"], F.lit('", '),
        F.when(
            is_write(e["verb"]),
            F.concat(F.lit('"action": {"name": "'), e["verb"], F.lit('", "arguments": {"k": '), e["k"], F.lit("}}")),
        ).otherwise(F.lit('"final_answer": "done"')),
        F.lit("}"),
    )
    listed = F.concat(F.lit('Here: {"thoughts": ['), _join(F.transform("evs", thought), ", "), F.lit("]}"))
    call = F.concat(F.lit('<tool_call>{"name": "'), F.col("evs")[0]["verb"], F.lit('", "arguments": {}}</tool_call>'))
    text = (
        F.when(q % 4 == 0, listed).when(q % 4 == 1, call).when(q % 4 == 2, F.lit(" All is done. ")).otherwise("  ")
    )
    judge = (
        F.when(q % 3 == 0, F.lit('{"best_thought_id": "T2", "reason": "safe"}'))
        .when(q % 3 == 1, F.lit("I like T3 better than T4")).otherwise("no idea, T99 perhaps")
    )
    return blocks(spark, sf_dir).select("query_id", text.alias("thoughts_text"), judge.alias("judge_text"))


def routing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing texts naming the tools of the events: clean list, comma text, prose, nothing."""
    q = F.col("query_id")
    names = F.transform("evs", lambda e: F.concat(domain_of(q), F.lit("__"), e["verb"]))
    quoted = F.concat(F.lit('["'), _join(names, '", "'), F.lit('"]'))
    text = (
        F.when(q % 4 == 0, F.concat(F.lit('{"selected_tools": '), quoted, F.lit("}")))
        .when(q % 4 == 1, F.concat(F.lit('Use {"selected_tools": [], "tools": "'), _join(names, " , "), F.lit('"}.')))
        .when(q % 4 == 2, F.concat(F.lit("Best use "), names[0])).otherwise("none of them")
    )
    gold_names = F.transform(
        F.filter("evs", lambda e: is_write(e["verb"])), lambda e: F.concat(domain_of(q), F.lit("__"), e["verb"])
    )
    return blocks(spark, sf_dir).select(
        "query_id", text.alias("routing_text"), gold_names.alias("gold_tools"), names.alias("called")
    )


