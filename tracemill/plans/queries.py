"""The registered queries: every operator run over the whole driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import constants as C
from tracemill import schemas
from tracemill.functions import jsontext as J
from tracemill.functions import text as X
from tracemill.operators import datasets as D
from tracemill.operators import episodes as E
from tracemill.operators import replay as R
from tracemill.operators import reports as P
from tracemill.operators import score as S
from tracemill.operators import toolset as TS
from tracemill.operators import transcripts as TX
from tracemill.operators import trials as TR
from tracemill.plans import standins as I
from tracemill.session import shared_dir
from tracemill.sources import catalogue as K
from tracemill.sources import files
from tracemill.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BY = ("domain", "config")
NOW = dt.datetime(2023, 11, 30, 0, 0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(spark, sf):
    return S.harmonise(I.results(spark, sf, spread=True), I.gold(spark, sf, spread=True))


def _scored(spark, sf):
    return S.score(I.results(spark, sf, spread=True), I.gold(spark, sf, spread=True), I.tools(spark), I.base_state(spark, sf))


def _matched(spark, sf):
    """Rows with the exact match as their correctness: reports that need no replay."""
    return S.match_flags(_joined(spark, sf), I.tools(spark)).withColumn("correct", F.col("exact_match"))


def _accuracy(spark, sf):
    return P.accuracy(_matched(spark, sf))


def _r6(c):
    return F.round(c, 6)


def _round_all(df: DataFrame) -> DataFrame:
    return P.rounded(df, 6)


# --- expressions on queries, tools and actions -------------------------------------------


@query
def domain_lists(spark, sf):
    q = TS.parse_domains(I.queries(spark, sf))
    return q.select("query_id", F.array_join("domains", ",").alias("domains"), F.size("domains").cast("long").alias("n"))


@query
def tool_ids(spark, sf):
    calls = I.routing_texts(spark, sf).select("query_id", F.posexplode("called").alias("p", "tool"))
    named = F.concat("tool", F.lit("__v2"))
    return calls.select("query_id", (F.col("p") + 1).cast("long").alias("step"), X.internal_tool_id(named).alias("tool"))


@query
def rendered_actions(spark, sf):
    e = I.events(spark, sf)
    arg = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    flag = X.scalar_text(F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "null").otherwise(F.col("k")))
    args = F.array(arg("z", F.col("k")), arg("a", flag))
    return e.select("event_id", X.render_action(F.concat(F.lit("email__"), "verb"), args).alias("action"))


@query
def action_functions(spark, sf):
    acts = R.explode_actions(I.results(spark, sf), S.KEYS, "function_calls")
    return acts.groupBy(X.function_name(F.col("action")).alias("function")).agg(F.count("*").alias("n"))


@query
def escaped_actions(spark, sf):
    j = _joined(spark, sf)
    return j.select("run_id", "query_id", F.posexplode("prediction").alias("p", "action")).where(
        F.contains("action", F.lit("\\n"))
    ).select("run_id", "query_id", (F.col("p") + 1).cast("long").alias("step"), "action")


@query
def label_slugs(spark, sf):
    c = I.load(spark, sf, "customer")
    return c.select("c_custkey", X.slug(F.concat(F.lit("#"), "c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))).alias("label"))


@query
def config_labels(spark, sf):
    r = I.results(spark, sf)
    base = F.when(F.col("query_id") % 2 == 0, "tool_calling").otherwise("react")
    return r.groupBy(X.config_label(F.col("config"), base).alias("label")).agg(F.count("*").alias("n"))


@query
def folded_state(spark, sf):
    s = I.base_state(spark, sf).withColumn("attrs", X.fold_state(F.col("attrs")))
    return s.select("target", "entity_id", F.col("attrs.name").alias("name"), F.col("attrs.status").alias("status"))


@query
def harmonised_pairs(spark, sf):
    j = _joined(spark, sf)
    return j.select(
        "run_id", "query_id", "error", F.size("prediction").cast("long").alias("n_prediction"),
        F.size("ground_truth").cast("long").alias("n_gold"),
        F.array_join("ground_truth", " | ").alias("ground_truth"),
    )


@query
def action_steps(spark, sf):
    return R.explode_actions(I.results(spark, sf), S.KEYS, "function_calls")


# --- predicates and exact comparison -------------------------------------------------------


@query
def side_effect_actions(spark, sf):
    j = _joined(spark, sf).withColumn("names", S.side_effect_names(I.tools(spark)))
    kept = S.side_effect_actions(F.col("prediction"), F.col("names"))
    return j.select("run_id", "query_id", F.array_join(kept, " | ").alias("writes"))


@query
def exact_matches(spark, sf):
    return _matched(spark, sf).select("run_id", "query_id", "exact_match")


@query
def error_flags(spark, sf):
    j = _joined(spark, sf)
    p, g = F.col("prediction"), F.col("ground_truth")
    return j.select(
        "run_id", "query_id", (F.size(p) == 0).alias("no_actions"), S.wrong_email(p).alias("wrong_email"),
        S.end_date_minor_error(g, p).alias("end_date_minor_error"),
        S.meeting_start_time_error(g, p).alias("meeting_start_time_error"),
    )


@query
def iteration_limit_rows(spark, sf):
    return S.iteration_limit_rows(I.results(spark, sf)).select("run_id", "query_id", "error")


@query
def cardinality_audit(spark, sf):
    """Some gold rows left out, some doubled, in each run other predictions left out."""
    g = I.gold(spark, sf).where("query_id % 101 <> 0")
    g = g.unionByName(g.where("query_id % 107 = 1"))
    c = F.array_position(F.array(*map(F.lit, I.CONFIGS)), F.col("config")) - 1
    p = I.results(spark, sf).where((F.col("query_id") + c) % 103 != 0)
    return S.cardinality_audit(p, g)


@query
def joined_on_text(spark, sf):
    j = S.harmonise(I.results(spark, sf).drop("query_id"), I.gold(spark, sf), on="query")
    return j.groupBy(*BY).agg(F.count("*").alias("n"), F.sum(F.size("ground_truth")).cast("long").alias("n_gold_actions"))


@query
def action_differences(spark, sf):
    return S.action_differences(_joined(spark, sf))


# --- replay and score ----------------------------------------------------------------------


@query
def replayed_changes(spark, sf):
    r = I.results(spark, sf, spread=True).withColumn("function_calls", X.escape_newlines(F.col("function_calls")))
    acts = R.explode_actions(r, S.KEYS, "function_calls")
    return R.deltas(R.replay(acts, I.tools(spark), I.base_state(spark, sf), S.KEYS), S.KEYS)


@query
def outcome_equality(spark, sf):
    o = S.with_outcomes(I.results(spark, sf, spread=True), I.gold(spark, sf, spread=True), I.tools(spark), I.base_state(spark, sf))
    return o.select(
        "run_id", "query_id", "same_outcome", "changed", F.size("delta").cast("long").alias("n_cells"),
        F.size("gold_delta").cast("long").alias("n_gold_cells"),
    )


@query
def state_difference(spark, sf):
    o = S.with_outcomes(I.results(spark, sf, spread=True), I.gold(spark, sf, spread=True), I.tools(spark), I.base_state(spark, sf))
    return R.state_difference(o, S.KEYS)


FLAGS = ("exact_match", "correct", "unwanted_side_effects", *S.CAUSES)


@query
def scored_runs(spark, sf):
    return _scored(spark, sf).select("run_id", "query_id", "domain", "config", *FLAGS)


@query
def residual_errors(spark, sf):
    rest = S.residual_errors(_scored(spark, sf))
    return rest.select("run_id", "query_id", "unwanted_side_effects", F.array_join("prediction", " | ").alias("prediction"))


@query
def custom_error_class(spark, sf):
    extra = {"wrong_case": F.exists("prediction", lambda a: F.contains(a, F.lit("ITEM")))}
    s = S.score(
        I.results(spark, sf, spread=True), I.gold(spark, sf, spread=True), I.tools(spark), I.base_state(spark, sf), error_classes=extra
    )
    out = P.error_classes(s, (*S.CAUSES, "wrong_case"))
    return out.select("domain", "config", "n", "n_wrong_case", "n_residual")


@query
def added_tool(spark, sf):
    """A catalogue row more makes a reading tool a deleting one, without code."""
    t = I.tools(spark)
    more = {
        "tool": "email__search_items", "domain": "email", "description": "", "params": [], "side_effect": True,
        "op_kind": "delete", "target": "email", "key_arg": "k",
    }
    t = t.where("tool <> 'email__search_items'").unionByName(K.catalogue(spark, [more]))
    s = S.score(I.results(spark, sf, spread=True), I.gold(spark, sf, spread=True), t, I.base_state(spark, sf))
    return P.accuracy(s, ("domain",)).select("domain", "n", "n_correct")


# --- reports ---------------------------------------------------------------------------------


@query
def accuracy_by_config(spark, sf):
    return _round_all(P.accuracy(_scored(spark, sf)))


@query
def error_rates(spark, sf):
    return _round_all(P.error_rates(_scored(spark, sf)))


@query
def error_classes(spark, sf):
    return P.error_classes(_scored(spark, sf))


@query
def leaderboard(spark, sf):
    return _round_all(P.leaderboard(_accuracy(spark, sf), I.CONFIGS))


@query
def best_per_domain(spark, sf):
    return _round_all(P.best_per_domain(_accuracy(spark, sf)))


@query
def deltas_to_baseline(spark, sf):
    return _round_all(P.deltas_to_baseline(_accuracy(spark, sf), "domains"))


@query
def cross_domain_totals(spark, sf):
    return _round_all(P.totals(_accuracy(spark, sf)))


@query
def iteration_limit_share(spark, sf):
    return _round_all(P.iteration_limit_share(I.results(spark, sf)))


@query
def repeated_actions(spark, sf):
    return P.repeated_actions(I.results(spark, sf))


@query
def tool_usage(spark, sf):
    return _round_all(P.tool_usage(_matched(spark, sf)))


@query
def appended_results(spark, sf):
    r = I.results(spark, sf)
    later = r.where("config = 'all'").drop("error")
    both = r.unionByName(later, allowMissingColumns=True)
    return both.groupBy(*BY).agg(F.count("*").alias("n"), F.count("error").alias("n_error_known"))


# --- tool sets ---------------------------------------------------------------------------------


def _queries(spark, sf):
    return TS.parse_domains(I.queries(spark, sf))


@query
def tool_catalogue(spark, sf):
    """Catalogue rows with how often the events call them."""
    t = I.tools(spark)
    called = I.routing_texts(spark, sf).select(F.explode("called").alias("tool"))
    n = called.groupBy("tool").agg(F.count("*").alias("calls"))
    return t.join(n, "tool", "left").select(
        X.internal_tool_id(F.col("tool")).alias("tool"), "domain", "side_effect", "op_kind",
        F.coalesce("calls", F.lit(0)).cast("long").alias("calls"),
    )


@query
def query_tools(spark, sf):
    return TS.query_tools(_queries(spark, sf), I.tools(spark)).select("query_id", "tool")


@query
def query_tools_all(spark, sf):
    t = TS.query_tools(_queries(spark, sf), I.tools(spark), "all")
    return t.groupBy("query_id").agg(F.count("*").alias("n"))


@query
def unknown_tools(spark, sf):
    known = I.tools(spark).where("tool <> 'analytics__delete_item'")
    calls = I.routing_texts(spark, sf).select("query_id", F.explode("called").alias("tool"))
    return TS.unknown_tools(calls, known).groupBy("query_id", "tool").agg(F.count("*").alias("n"))


@query
def unavailable_tools(spark, sf):
    calls = I.routing_texts(spark, sf).select("query_id", F.explode("called").alias("tool"))
    return TS.unavailable_tools(calls, _queries(spark, sf), I.tools(spark)).groupBy("query_id", "tool").agg(
        F.count("*").alias("n")
    )


@query
def first_queries(spark, sf):
    return TS.first_queries(I.queries(spark, sf), 100).select("query_id", "query")


@query
def tool_texts(spark, sf):
    return D.tool_texts(_queries(spark, sf), I.tools(spark)).select("query_id", "tools_text")


# --- episodes ------------------------------------------------------------------------------------


def _episodes(spark, sf):
    return I.memory_queries(spark, sf).where("stored")


@query
def eligible_signatures(spark, sf):
    return TS.eligible_signatures(_episodes(spark, sf), I.memory_queries(spark, sf))


@query
def eligible_counts(spark, sf):
    return E.eligible_counts(_episodes(spark, sf), I.memory_queries(spark, sf))


@query
def similar_episodes(spark, sf):
    return E.similar_episodes(_episodes(spark, sf), I.memory_queries(spark, sf), 3)


@query
def similar_episodes_by_levels(spark, sf):
    """The same with few postings a term at level 0, so that small tables go through the deeper levels."""
    return E.similar_episodes(_episodes(spark, sf), I.memory_queries(spark, sf), 3, max_postings=16)


@query
def cold_start(spark, sf):
    m = E.cold_start(I.memory_queries(spark, sf), F.col("stored"), 5)
    return m.select("run_id", "seq", "store_size", "may_retrieve")


@query
def few_shot_picks(spark, sf):
    q = TS.with_available(_queries(spark, sf), I.tools(spark))
    ex = I.examples(spark, sf)
    # Tools of an example: its verbs in its own domain.
    own = F.transform("tools", lambda t: F.concat(F.col("domains")[0], F.lit("__"), t))
    return E.few_shot(ex.withColumn("tools", own), q, 3)


def _gated(spark, sf):
    o = S.with_outcomes(I.results(spark, sf, spread=True), I.gold(spark, sf, spread=True), I.tools(spark), I.base_state(spark, sf))
    return E.gate(
        o.withColumns(
            {"n_actions": F.size("prediction").cast("long"), "n_gold": F.size("ground_truth").cast("long")}
        )
    )


@query
def gated_runs(spark, sf):
    return _gated(spark, sf).select("run_id", "query_id", "gate_status")


@query
def gate_counts(spark, sf):
    return E.gate_counts(_gated(spark, sf))


@query
def demonstration_messages(spark, sf):
    m = I.memory_queries(spark, sf)
    store = m.where("stored").select(
        "run_id", F.col("seq").alias("e_seq"), "query", I.memory_actions(F.col("seq"), F.col("tools")).alias("actions"),
        F.lit("done").alias("final_answer"),
    )
    picks = E.similar_episodes(_episodes(spark, sf), m, 2)
    prefix = D.demonstrations(picks, store, ["run_id", "seq"], ["run_id", "e_seq"])
    return D.message_rows(prefix, "prefix", ["run_id", "seq"])


# --- trials ----------------------------------------------------------------------------------------


@query
def judge_decisions(spark, sf):
    return TR.judge_decisions(I.trials(spark, sf)).select("query_id", "trial", "success", "reason")


@query
def verifier_decisions(spark, sf):
    return TR.verifier_decisions(I.trials(spark, sf)).select("query_id", "trial", "verdict")


@query
def chosen_trials(spark, sf):
    return TR.choose_trial(TR.judge_decisions(I.trials(spark, sf))).select("query_id", "trial", "settled")


@query
def chosen_attempts(spark, sf):
    picked = TR.choose_attempt(I.trials(spark, sf))
    return picked.select("query_id", "trial", F.size("calls").cast("long").alias("n_calls"), "settled")


@query
def chosen_drafts(spark, sf):
    t = TR.verifier_decisions(I.trials(spark, sf))
    drafts = t.select("query_id", (F.col("trial") - 1).alias("draft"), "reflection")
    checks = t.select("query_id", F.col("trial").alias("round"), "verdict")
    return TR.choose_draft(drafts, checks).select("query_id", "draft", "verified")


@query
def reflection_buffers(spark, sf):
    b = TR.reflection_buffer(I.trials(spark, sf), 2)
    return b.select("query_id", "trial", F.array_join("buffer", " || ").alias("buffer"))


def _truth(spark, sf, judged):
    truth = I.load(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("truth"))
    return judged.join(truth, "query_id")


@query
def judge_quality(spark, sf):
    judged = _truth(spark, sf, TR.judge_decisions(I.trials(spark, sf)))
    return _round_all(TR.judge_quality(judged, "success", "truth"))


@query
def verifier_quality(spark, sf):
    judged = _truth(spark, sf, TR.verifier_decisions(I.trials(spark, sf)))
    return _round_all(TR.judge_quality(judged, "verdict", "truth"))


@query
def reflected_queries(spark, sf):
    b = TR.reflection_buffer(I.trials(spark, sf), 3)
    q = F.concat(F.lit("request "), F.col("query_id").cast("string"))
    return b.select("query_id", "trial", D.reflected_query(q, F.col("buffer")).alias("user_query"))


# --- transcripts ---------------------------------------------------------------------------------------


@query
def json_objects(spark, sf):
    text = F.concat("event_type", F.lit(" "), "props", F.lit(' then {"outer": '), "props", F.lit(', "x": [true]} {bad'))
    ev = I.load(spark, sf, "events").select("event_id", text.alias("text"))
    return TX.json_object_table(ev, "text", ["event_id"])


@query
def json_objects_lateral(spark, sf):
    J.register(spark)
    ev = I.load(spark, sf, "events").select("event_id", F.concat(F.lit("{"), "props").alias("text"))
    return spark.sql("SELECT event_id, o.ord, o.object FROM {ev}, LATERAL json_objects(text) o", ev=ev)


@query
def tool_calls(spark, sf):
    t = TX.tool_call_table(I.call_texts(spark, sf), "text", ["query_id"])
    return t.select("query_id", "step", "tool", "action", "args_json")


@query
def malformed_rate(spark, sf):
    return _round_all(TX.malformed_rate(I.call_texts(spark, sf), "text", ["domain"]))


@query
def routed_tools(spark, sf):
    q = TS.with_available(_queries(spark, sf), I.tools(spark))
    r = TX.routing_table(I.routing_texts(spark, sf).join(q.select("query_id", "available"), "query_id"))
    r = TX.routing_recall(r)
    return r.select(
        "query_id", "routed", F.array_join("selected", ",").alias("selected"), _r6("recall").alias("recall")
    )


@query
def thought_candidates(spark, sf):
    c = TX.candidate_table(TX.candidates(I.thought_texts(spark, sf)), ["query_id"])
    return c


@query
def chosen_candidates(spark, sf):
    c = TX.chosen_candidate(TX.candidates(I.thought_texts(spark, sf)))
    return c.select("query_id", "chosen_id")


@query
def candidate_texts(spark, sf):
    c = TX.candidates(I.thought_texts(spark, sf))
    return c.select("query_id", D.candidates_text(F.col("candidates")).alias("text"))


def _plans(spark, sf, cap=None):
    steps = TX.plan_table(I.plan_texts(spark, sf), "text", ["query_id"])
    return TX.plans(steps, ["query_id"], cap)


@query
def plan_steps(spark, sf):
    return TX.plan_table(I.plan_texts(spark, sf), "text", ["query_id"])


@query
def capped_plans(spark, sf):
    p = _plans(spark, sf, 6)
    return p.select("query_id", F.array_join("steps.var", ",").alias("vars"), "too_long")


@query
def resolved_steps(spark, sf):
    p = _plans(spark, sf)
    seen = F.transform("steps", lambda s: F.concat(F.lit("o"), F.substring(s["var"], 2, 9)))
    return TX.resolved_steps(p.withColumn("observations", seen), ["query_id"]).select(
        "query_id", "step", "var", "resolved", "needs_repair"
    )


@query
def solver_prompts(spark, sf):
    q = F.concat(F.lit("request "), F.col("query_id").cast("string"))
    seen = F.transform(
        "steps", lambda s: F.struct(s["var"].alias("var"), F.concat(F.lit("saw "), s["tool_name"]).alias("observation"))
    )
    p = _plans(spark, sf)
    return p.select("query_id", D.solver_query(q, F.array_join("steps.thought", "; "), seen).alias("user_query"))


@query
def transcript_sections(spark, sf):
    return TX.sections(I.responses(spark, sf), "full_response", ["query_id"])


@query
def custom_markers(spark, sf):
    marks = [("note", r"note \d+"), ("ok", r"ok \d+")]
    s = TX.sections(I.responses(spark, sf), "full_response", ["query_id"], marks)
    return s.groupBy("phase").agg(F.count("*").alias("n"))


@query
def generation_cost(spark, sf):
    shapes = ("reflexion", "plan_then_act", "react", "route_then_act")
    r = I.responses(spark, sf).withColumn("shape", I._pick(shapes, F.col("query_id") % 4))
    return _round_all(TX.generation_cost(TX.sections(r, "full_response", ["query_id", "config", "shape"]), ["query_id"]))


@query
def turn_table(spark, sf):
    """Turns and their first calls: blocks between observations, blocks and text without observations, one text without blocks."""
    t = I.call_texts(spark, sf)
    bare = F.regexp_replace("text", "\nObservation:\nok\n", " so then ")
    shaped = t.withColumn("shape", F.when(F.col("query_id") % 2 == 0, "react").otherwise("direct"))
    shaped = shaped.withColumn("text", F.when(F.col("shape") == "react", F.col("text")).otherwise(bare))
    turns = TX.turn_table(TX.sections(shaped, "text", ["query_id", "shape"]), ["query_id"])
    return turns.select("query_id", "ord", "turn", "phase", "tool")


# --- datasets --------------------------------------------------------------------------------------------


HEAD = f"Date: {NOW.date()}.\n"


@query
def system_prompts(spark, sf):
    """Every phase in turn."""
    phased = _queries(spark, sf).withColumn("phase", I._pick(tuple(D.TEMPLATES), F.col("query_id") % len(D.TEMPLATES)))
    return D.system_prompts(phased, I.tools(spark), D.templates(spark, head=HEAD))


def _traces(spark, sf):
    """Structured actions of every trace, two calls to a turn."""
    acts = F.transform(
        "evs",
        lambda e: F.struct(
            F.ceil(e["step"] / 2).alias("turn"), e["verb"].alias("name"),
            F.concat(F.lit('{"k": "'), e["k"], F.lit('"}')).alias("args_json"),
            F.concat(F.lit("seen "), e["k"]).alias("observation"),
        ),
    )
    answer = F.when(F.col("query_id") % 3 == 0, "").otherwise("done")
    return I.blocks(spark, sf).select(
        "query_id", F.when(F.col("query_id") % 19 == 0, F.slice(acts, 1, 0)).otherwise(acts).alias("actions"),
        answer.alias("final_answer"),
    )


@query
def trajectory_texts(spark, sf):
    t = _traces(spark, sf)
    return t.select("query_id", D.trajectory_text(F.col("actions"), F.col("final_answer")).alias("trajectory"))


@query
def follow_up_prompts(spark, sf):
    t = _traces(spark, sf)
    q = F.concat(F.lit("request "), F.col("query_id").cast("string"))
    tr = D.trajectory_text(F.col("actions"), F.col("final_answer"))
    return t.select(
        "query_id", D.planned_query(q, F.lit("- look up")).alias("planned"),
        D.correction_query(q, tr, F.lit("VERDICT: INCORRECT")).alias("correction"),
        D.evaluator_query(q, tr).alias("evaluator"),
    )


@query
def phase_prompts(spark, sf):
    """The requests that open the other phases of a run."""
    t = _traces(spark, sf)
    q = F.concat(F.lit("request "), F.col("query_id").cast("string"))
    tr = D.trajectory_text(F.col("actions"), F.col("final_answer"))
    first = F.try_element_at("actions", F.lit(1))
    evidence = F.transform("actions", lambda a, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("var"), a["observation"].alias("observation")))
    params = F.array(F.struct(F.lit("k").alias("name"), F.lit(None).cast("string").alias("type"), F.lit("item number").alias("description")))
    return t.select(
        "query_id", D.verification_query(q, tr).alias("verification"), D.next_step_query(F.concat(F.lit("seen "), q)).alias("next_step"),
        D.choice_query(tr).alias("choice"), D.reflection_query(q, tr, F.when(F.col("query_id") % 2 == 0, F.lit("late"))).alias("reflection"),
        D.repair_query(F.coalesce(first["name"], F.lit("none")), params, F.coalesce(first["args_json"], F.lit("{}")), evidence).alias("repair"),
    )


@query
def few_shot_messages(spark, sf):
    """The examples picked for each query as messages before its request."""
    store = I.examples(spark, sf).select("pos", "query", "actions", "final_answer")
    prefix = D.demonstrations(QUERIES["few_shot_picks"](spark, sf), store, ["query_id"], ["pos"])
    return D.message_rows(prefix, "prefix", ["query_id"])


@query
def chat_messages(spark, sf):
    t = _traces(spark, sf)
    q = F.concat(F.lit("request "), F.col("query_id").cast("string"))
    msgs = D.chat_messages(F.lit("system text"), q, F.col("actions"), final_answer=F.col("final_answer"))
    return D.message_rows(t.withColumn("messages", msgs), "messages", ["query_id"])


# --- files and streams -------------------------------------------------------------------------------------


@query
def queries_from_csv(spark, sf):
    path = shared_dir(spark)
    g = I.gold(spark, sf).join(_queries(spark, sf).select("query_id", "domains"), "query_id")
    files.write_queries(g, path)
    back = files.read_queries(spark, path)
    return back.select(
        "query", F.size("answer").cast("long").alias("n_answer"), F.array_join("answer", " | ").alias("answer"),
        F.array_join("domains", ",").alias("domains"),
    )


@query
def result_history(spark, sf):
    root = shared_dir(spark)
    r = I.results(spark, sf)
    for config in I.CONFIGS:
        mine = r.where(F.col("config") == config)
        files.export_results(mine, root, "mixed", "model-7b", f"{config}_react", "2024-01-31_10-20-30")
    back = files.read_history(spark, root)
    return back.select(
        "domain", "label", "mode", "time", "query", F.array_join("function_calls", " | ").alias("function_calls"), "error"
    )


@query
def scored_from_files(spark, sf):
    """Query and result files scored as they are: both meet on the text of the query, each run is a file."""
    root, asked = shared_dir(spark), shared_dir(spark)
    g = I.gold(spark, sf).join(_queries(spark, sf).select("query_id", "domains"), "query_id")
    files.write_queries(g, asked)
    for config in I.CONFIGS:
        mine = I.results(spark, sf).where(F.col("config") == config)
        files.export_results(mine, root, "mixed", "model-7b", config, "2024-01-31_10-20-30")
    gold, made = files.read_queries(spark, asked), files.read_history(spark, root).withColumnRenamed("mode", "config")
    s = S.score(made, gold, I.tools(spark), I.base_state(spark, sf))
    return s.select("domain", "config", "query", *FLAGS)


@query
def result_tables(spark, sf):
    root = shared_dir(spark)
    files.write_results(I.results(spark, sf), root)
    back = files.read_results(spark, root)
    return back.groupBy("domain", "config").agg(
        F.count("*").alias("n"), F.sum(F.size("function_calls")).cast("long").alias("n_calls")
    )


def _as_episodes(df):
    acts = F.transform(
        I.memory_actions(F.col("seq"), F.col("tools")),
        lambda a: F.struct(
            a["name"].alias("name"),
            F.array(F.struct(F.lit("k").alias("name"), F.col("seq").cast("string").alias("value"))).alias("args"),
            a["observation"].alias("observation"),
        ),
    )
    return df.select(
        F.col("run_id").cast("string").alias("run_id"), "seq", "query", acts.alias("actions"),
        F.lit("done").alias("final_answer"), F.lit(True).alias("verified"),
    )


@query
def episode_store(spark, sf):
    """Two overlapping appends, once as Parquet and once as JSON."""
    ep = _as_episodes(_episodes(spark, sf))
    out = None
    for fmt in ("parquet", "json"):
        path = shared_dir(spark)
        files.append_episodes(ep.where("seq % 2 = 0"), path, fmt)
        files.append_episodes(ep, path, fmt)
        part = files.read_episodes(spark, path, fmt).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out.select(
        "fmt", "run_id", "seq", "query", F.array_join("actions.name", ",").alias("tools"),
        F.col("actions")[0]["args"][0]["value"].alias("k"),
    )


@query
def example_file(spark, sf):
    path = shared_dir(spark)
    ex = I.examples(spark, sf)
    ep = _as_episodes(I.memory_queries(spark, sf)).select("seq", "actions")
    ex.drop("actions").join(ep, F.col("pos") == F.col("seq")).select(*schemas.EXAMPLES.names).write.json(path)
    return files.read_examples(spark, path, lines=True).groupBy("domain_key").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )


@query
def streamed_scores(spark, sf):
    root = shared_dir(spark)
    files.write_results(I.results(spark, sf), f"{root}/results")
    job = jobs.score_stream(
        jobs.result_stream(spark, f"{root}/results"), I.gold(spark, sf), I.tools(spark), I.base_state(spark, sf),
        f"{root}/scored", f"{root}/checkpoint",
    )
    job.awaitTermination()
    return spark.read.parquet(f"{root}/scored").select("run_id", "query_id", "domain", "config", *FLAGS)


@query
def streamed_retrieval(spark, sf):
    """Three deliveries, each a batch: queries retrieve from what earlier batches have stored. Some rows are delivered twice."""
    root = shared_dir(spark)
    m = I.memory_queries(spark, sf)
    rows = _as_episodes(m).join(m.select("seq", "available", "stored"), "seq").withColumns(
        {"error": F.lit(""), "n_actions": F.lit(1).cast("long"), "same_outcome": F.col("stored"), "n_gold": F.lit(1).cast("long")}
    )
    for part in range(3):
        again = (F.col("seq") % 3 == part - 1) & (F.col("seq") % 5 == 0)
        rows.where((F.col("seq") % 3 == part) | again).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        jobs.retrieve_and_keep(stream, f"{root}/store", f"{root}/out", f"{root}/checkpoint", 2).awaitTermination()
    got = spark.read.schema("run_id string, seq long, e_seq long, score double, rank long, batch long").parquet(f"{root}/out")
    return got.select("batch", "run_id", "seq", "e_seq", "rank", F.round("score", 6).alias("score"))


@query
def streamed_episodes(spark, sf):
    root = shared_dir(spark)
    judged = _as_episodes(I.memory_queries(spark, sf)).withColumns(
        {
            "error": F.when(F.col("seq") % 11 == 0, C.ITERATION_LIMIT).otherwise(""),
            "n_actions": F.size("actions").cast("long"), "same_outcome": F.col("seq") % 4 != 0,
            "n_gold": F.col("seq") % 9,
        }
    )
    judged.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(judged.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.keep_episodes(stream, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return files.read_episodes(spark, f"{root}/store").select("run_id", "seq", "query")
