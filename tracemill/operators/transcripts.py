"""Tables read out of model transcripts.

Arrays that are costly to read are exploded with the outer form and then filtered:
for the plain form the optimiser adds a filter that would read them twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import constants as C
from tracemill.functions import jsontext as J
from tracemill.functions import text as X


def json_object_table(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per JSON object embedded in the text, nested objects after their parent."""
    rows = df.select(*keys, F.posexplode_outer(J.json_objects(F.col(text))).alias("_p", "object"))
    return rows.where(F.col("_p").isNotNull()).select(
        *keys, (F.col("_p") + 1).cast("long").alias("ord"), "object"
    )


def tool_call_table(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per tool call: ``step, tool, args, args_json, action``."""
    calls = df.select(*keys, J.tool_calls(F.col(text)).alias("calls"))
    rows = calls.select(*keys, F.posexplode_outer("calls").alias("_p", "c")).where(F.col("_p").isNotNull())
    return rows.select(
        *keys, (F.col("_p") + 1).cast("long").alias("step"),
        F.col("c.name").alias("tool"), F.col("c.args").alias("args"), F.col("c.args_json").alias("args_json"),
        X.render_action(F.col("c.name"), F.col("c.args")).alias("action"),
    )


def malformed_rate(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """Share of call blocks that hold no readable call."""
    blocks = F.size(F.regexp_extract_all(F.col(text), F.lit(C.CALL_BLOCK), 1))
    calls = F.size(J.tool_calls(F.col(text)))
    counted = df.select(*by, blocks.alias("b"), F.least(blocks, calls).alias("c"))
    return counted.groupBy(*by).agg(
        F.sum("b").cast("long").alias("n_blocks"),
        F.sum(F.col("b") - F.col("c")).cast("long").alias("n_malformed"),
    ).withColumn("rate", F.when(F.col("n_blocks") > 0, F.col("n_malformed") / F.col("n_blocks")))


def routing_table(df: DataFrame, text: str = "routing_text") -> DataFrame:
    """Adds ``selected``, the tools a routing text chose; ``routed`` is false if it chose none
    and all tools stay. Needs ``available``."""
    chosen = J.selected_tools(F.col(text), F.col("available"))
    return df.withColumn("selected", chosen).withColumns(
        {
            "routed": F.size("selected") > 0,
            "selected": F.when(F.size("selected") > 0, F.col("selected")).otherwise(F.col("available")),
        }
    )


def routing_recall(routed: DataFrame, gold_tools: str = "gold_tools") -> DataFrame:
    """Share of the tools the gold actions use that were selected; null if gold uses none."""
    wanted = F.array_distinct(F.col(gold_tools))
    met = F.size(F.array_intersect(wanted, F.col("selected")))
    return routed.withColumn("recall", F.when(F.size(wanted) > 0, met / F.size(wanted)))


def candidates(df: DataFrame, text: str = "thoughts_text") -> DataFrame:
    """Adds ``candidates``, the thought candidates of a text."""
    return df.withColumn("candidates", J.thoughts(F.coalesce(F.col(text), F.lit("")), X.stripped))


def candidate_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("candidates").alias("_p", "c")).select(
        *keys, (F.col("_p") + 1).cast("long").alias("ord"), "c.*"
    )


def _mentioned(text: Column, word: Column) -> Column:
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.regexp_like(text, quoted)


def chosen_candidate(df: DataFrame, judge_text: str = "judge_text") -> DataFrame:
    """Adds ``chosen_id``: the candidate a judge named in JSON, else the first one it mentions
    as a word, else the first. A single candidate needs no judge."""
    ids = F.transform("candidates", lambda c: c["id"])
    text = F.coalesce(F.col(judge_text), F.lit(""))
    named = F.filter(J.picked_ids(text), lambda i: F.array_contains(ids, i))
    spoken = F.filter(ids, lambda i: _mentioned(text, i))
    first = lambda a: F.try_element_at(a, F.lit(1))
    pick = F.when(F.size(ids) == 1, first(ids)).otherwise(F.coalesce(first(named), first(spoken), first(ids)))
    return df.withColumn("chosen_id", pick)


# --- plans with evidence -----------------------------------------------------------------

PLAN_STEP = "struct<var string, tool_name string, args_template string, thought string>"


def plan_table(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per plan step ``#E<n> = tool[..]``; steps whose bracket never closes drop out.

    ``part`` numbers the pieces between ``Plan:`` marks, ``step`` the steps kept, both from 1.
    """
    opening = C.PLAN_CALL.replace("{space}", X.SPACE)

    def cut(part: Column, i: Column) -> Column:
        # The pattern is searched once; its first match is also the first place of the matched text.
        return X.let(
            F.regexp_extract(part, opening, 0),
            lambda head: F.struct(
                (i + 1).cast("long").alias("part"), head.alias("head"),
                F.call_function("substring_index", part, head, F.lit(1)).alias("thought"), part.alias("text"),
            ),
        )

    parts = F.split(F.col(text), C.PLAN_MARK.replace("{space}", X.SPACE))
    after_first = X.let(parts, lambda ps: F.slice(ps, F.lit(2), F.size(ps)))
    found = F.filter(F.transform(after_first, cut), lambda c: c["head"] != "")
    rows = df.select(*keys, F.inline_outer(found)).where(F.col("part").isNotNull())
    body = J.closed_body(F.substr(F.col("text"), F.length("thought") + F.length("head") + 1))
    return rows.withColumn("_body", body).where(F.col("_body").isNotNull()).select(
        *keys, "part",
        F.concat(F.lit("E"), F.regexp_extract("head", opening, 1)).alias("var"),
        F.regexp_extract("head", opening, 2).alias("tool_name"),
        X.stripped(F.col("_body")).alias("args_template"), X.stripped(F.col("thought")).alias("thought"),
    )


def plans(steps: DataFrame, keys: Sequence[str], max_iterations: int | None = None) -> DataFrame:
    """Steps of each plan as one ordered array, cut to the step cap; ``too_long`` marks cut plans.

    A plan is one model text, so its steps are few.
    """
    row = F.struct("part", "var", "tool_name", "args_template", "thought")
    out = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("steps"))
    if max_iterations is None:
        return out.withColumn("too_long", F.lit(False))
    return out.select(
        *keys, F.slice("steps", 1, max_iterations).alias("steps"),
        (F.size("steps") > max_iterations).alias("too_long"),
    )


def _number(var: Column) -> Column:
    """Digits of a step variable without leading zeros."""
    return F.regexp_replace(F.substr(var, F.lit(2)), "^0+(?=.)", "")


def substitute_evidence(template: Column, evidence: Column) -> Column:
    """Replaces ``#<var>`` by its observation, the highest number first.

    ``evidence`` is ``array<struct<var, observation>>`` in the order it was collected; a later entry
    for the same variable replaces an earlier one.
    """
    last = F.filter(
        F.transform(evidence, lambda e, i: F.struct(
            # Numbers of any length, highest first: longer ones, then larger digits.
            (-F.length(_number(e["var"]))).alias("n"), F.translate(_number(e["var"]), "0123456789", "9876543210").alias("m"), i.alias("i"),
            e["var"].alias("var"), e["observation"].alias("observation"),
        )),
        lambda e: ~F.exists(
            F.slice(evidence, e["i"] + 2, F.greatest(F.size(evidence) - e["i"] - 1, F.lit(0))),
            lambda later: later["var"] == e["var"],
        ),
    )
    filled = F.aggregate(
        F.sort_array(last), template,
        lambda s, e: F.replace(s, F.concat(F.lit("#"), e["var"]), e["observation"]),
    )
    return F.when(F.contains(template, F.lit("#E")), filled).otherwise(template)


def resolved_steps(planned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per step with the evidence of the steps before it filled in.

    Needs ``steps`` and ``observations`` (same length). ``needs_repair`` marks arguments that are
    not a JSON object after filling in.
    """
    pairs = F.zip_with(
        "steps", "observations", lambda s, o: F.struct(s["var"].alias("var"), o.alias("observation"))
    )
    filled = F.transform(
        "steps",
        lambda s, i: F.struct(
            (i + 1).cast("long").alias("step"), s["var"].alias("var"), s["tool_name"].alias("tool_name"),
            s["args_template"].alias("args_template"),
            substitute_evidence(s["args_template"], F.slice("pairs", F.lit(1), i)).alias("resolved"),
        ),
    )
    rows = planned.withColumn("pairs", pairs).select(*keys, F.inline(filled))
    kind = F.schema_of_variant(F.try_parse_json("resolved"))
    return rows.withColumn("needs_repair", ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)))


# --- sections and cost -------------------------------------------------------------------

def sections(
    df: DataFrame, text: str, keys: Sequence[str], markers: Sequence[tuple[str, str]] = C.PHASE_MARKERS
) -> DataFrame:
    """A full response cut at its phase markers: ``ord, phase, text``.

    ``markers`` are ``(phase, pattern at a line start)``; pass your own for other transcripts.
    What stands before the first marker is the phase ``response``.
    """
    any_marker = "|".join(f"(?:{p})" for _, p in markers)
    parts = X.let(
        F.split(F.col(text), rf"(?<![^\n])(?={any_marker})"),
        lambda ps: F.transform(
            ps, lambda p, i: F.struct((i + 1).cast("long").alias("ord"), p.alias("part"), F.size(ps).alias("_n"))
        ),
    )
    rows = df.select(*keys, F.inline_outer(parts)).where(F.col("part").isNotNull())
    phase = F.lit("response")
    for name, pattern in reversed(markers):
        phase = F.when(F.col("part").rlike(rf"\A(?:{pattern})"), name).otherwise(phase)
    body = F.regexp_replace("part", rf"\A(?:{any_marker})\n?", "")
    inner = F.when(F.col("ord") < F.col("_n"), F.regexp_replace(body, r"\n\z", "")).otherwise(body)
    return rows.select(*keys, "ord", phase.alias("phase"), inner.alias("text"))


# How a transcript of each shape shows the model's turns, phase by phase. ``own``: the phase opens with a turn of its own. ``then``:
# what stands after that turn, or after what the runner wrote: one turn, or turns told apart by the calls they end with.
TURN_RULES = (
    ("direct", "response", False, "calls"),
    ("react", "response", False, "one"), ("react", "observation", False, "one"),
    ("plan_then_act", "plan", True, "calls"),
    ("route_then_act", "routing", True, None), ("route_then_act", "selected_tools", False, "calls"),
    ("self_reflection", "reflection", True, "one"),
    ("tree_of_thoughts", "candidates", True, None), ("tree_of_thoughts", "judge", True, None),
    ("rewoo", "plan", True, None), ("rewoo", "final_answer", True, None),
    ("reflexion", "buffer", False, "calls"), ("reflexion", "evaluator", True, None), ("reflexion", "reflection_added", True, None),
    ("critic", "draft", False, "calls"), ("critic", "verification", False, "calls"), ("critic", "correction", False, "calls"),
)
RULES = "shape string, phase string, own boolean, then string"


def turn_table(
    parts: DataFrame, keys: Sequence[str], shape: str = "shape", rules: Sequence[tuple] = TURN_RULES
) -> DataFrame:
    """One row per turn of the model: ``keys, ord, turn, phase, text, tool, args_json``, with the first call of the turn.

    ``parts`` are ``sections`` with the ``shape`` of their transcript; other shapes bring ``rules`` of their own. A turn ends with its
    run of call blocks, so blocks with only white space between them are one turn. Where a turn cannot be set apart from the
    one before it (a comment and the reply to it, a plan and an answer without calls), it has a row without text.
    """
    spark = parts.sparkSession
    known = spark.createDataFrame(list(rules), RULES).withColumnRenamed("shape", shape)
    met = parts.join(F.broadcast(known), [shape, "phase"])
    block = "<tool_call>"
    # Cut after each run of blocks; an own turn ends where the first block begins.
    lead = f"if(own, substring_index(text, '{block}', 1), '')"
    cut = "(?<=</tool_call>)(?!\\\\s*<tool_call>)"
    found = met.withColumn("text", F.coalesce("text", F.lit(""))).selectExpr(
        "*", f"{lead} AS lead", f"filter(split(substr(text, length({lead}) + 1), '{cut}'), p -> p rlike '\\\\S') AS runs"
    ).selectExpr(
        "*",
        # What the runner writes before the first mark may be nothing at all.
        """CASE WHEN then IS NULL THEN array(text)
                WHEN then = 'one' AND own THEN array(text, CAST(NULL AS string))
                WHEN then = 'one' THEN if(phase = 'response' AND NOT text rlike '\\\\S', array(), array(text))
                WHEN own THEN concat(array(lead), if(size(runs) = 0, array(CAST(NULL AS string)), runs))
                WHEN size(runs) > 0 THEN runs
                WHEN phase = 'response' THEN array()
                ELSE array(CAST(NULL AS string)) END AS said""",
    )
    rows = found.select(*keys, "ord", "phase", F.posexplode("said").alias("_p", "text"))
    first = F.try_element_at(J.tool_calls(F.coalesce("text", F.lit(""))), F.lit(1))
    return rows.withColumn("_c", first).select(
        *keys, "ord", (F.col("_p") + 1).cast("long").alias("turn"), "phase", "text", F.col("_c.name").alias("tool"), F.col("_c.args_json").alias("args_json")
    )


def generation_cost(
    parts: DataFrame, keys: Sequence[str], by: Sequence[str] = ("config",), shape: str = "shape",
    rules: Sequence[tuple] = TURN_RULES, ended_on_limit: str | None = None,
) -> DataFrame:
    """Per configuration: queries, generated turns, trials and verification rounds, and turns per query.

    Turns are those of ``turn_table``. Where the boolean column ``ended_on_limit`` is true and a transcript's last phase is an
    observation, nothing has replied to it.
    """
    group = list(dict.fromkeys([*by, *keys]))
    turns = turn_table(parts, group, shape, rules).groupBy(*group).agg(F.count("*").alias("turns"))
    n = lambda c: F.count_if(c).cast("long")
    limit = F.lit(False) if ended_on_limit is None else F.coalesce(F.bool_or(ended_on_limit), F.lit(False))
    unanswered = limit & (F.max_by("phase", "ord") == "observation") & F.coalesce(F.max_by(shape, "ord") == "react", F.lit(False))
    seen = parts.groupBy(*group).agg(
        unanswered.cast("long").alias("unanswered"), n(F.col("phase") == "trial").alias("trials"), n(F.col("phase") == "verification").alias("rounds"),
    )
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group]
    per_query = seen.alias("s").join(turns.alias("t"), same, "left").select(
        *[F.col(f"s.{c}").alias(c) for c in group], "trials", "rounds", (F.coalesce("turns", F.lit(0)) - F.col("unanswered")).alias("turns")
    )
    return per_query.groupBy(*by).agg(
        F.count("*").alias("n_queries"), F.sum("turns").alias("turns"), F.sum("trials").alias("trials"),
        F.sum("rounds").alias("rounds"), F.avg("turns").alias("turns_per_query"),
    )
