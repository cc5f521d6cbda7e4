"""Scoring predictions against gold action lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracemill import constants as C
from tracemill.functions import text as X
from tracemill.operators import replay as R
from tracemill.session import through_table

KEYS = ("run_id", "query_id")
CAUSES = ("no_actions", "wrong_email", "end_date_minor_error", "meeting_start_time_error")


def harmonise(results: DataFrame, gold: DataFrame, on: str = "query_id", also: Sequence[str] = ()) -> DataFrame:
    """Predictions with their gold lists; nulls become empty, newlines are escaped. ``also`` names more columns of gold to keep."""
    left = results.withColumnRenamed("function_calls", "prediction").fillna("")
    right = gold.select(on, F.col("answer").alias("ground_truth"), *also)
    clean = lambda c: X.escape_newlines(X.actions_or_empty(F.col(c)))
    return left.join(right, on).withColumns(
        {"prediction": clean("prediction"), "ground_truth": clean("ground_truth")}
    )


def cardinality_audit(results: DataFrame, gold: DataFrame, on: str = "query_id", run: str | None = "run_id") -> DataFrame:
    """Keys of each run that keep its predictions and gold from matching one to one, with the reason.

    Every run that occurs in ``results`` is held against all gold rows; without ``run`` the whole table is one run.
    Predictions are counted once, by run and key, into the shared folder. Then one grouping by key lists the runs a key has, so that its
    gaps are the other runs. The list of all runs (configurations, whatever the number of rows) is the only thing collected.
    """
    wanted = gold.groupBy(on).agg(F.count("*").alias("n_gold"))
    keys = [on] if run is None else [run, on]
    made = results.groupBy(*keys).agg(F.count("*").alias("n_predictions"))
    if run is None:
        listed = made.select(on, F.array(F.struct("n_predictions")).alias("made"))
        gap = F.struct(F.lit(0).cast("long").alias("n_predictions"))
        gaps = F.when(F.col("made").isNull(), F.array(gap))
    else:
        made = through_table(made)
        kind = made.schema[run].dataType
        runs = sorted((r[run] for r in made.select(run).distinct().collect()), key=lambda r: (r is None, r))
        listed = made.groupBy(on).agg(F.collect_list(F.struct(run, "n_predictions")).alias("made"))
        every = F.array(*[F.lit(r).cast(kind) for r in runs]).cast(ArrayType(kind))
        has = F.transform(F.coalesce("made", F.array().cast(listed.schema["made"].dataType)), lambda m: m[run])
        gaps = F.when(
            (F.col("n_gold") > 0) & (F.size(has) < len(runs)),
            F.transform(F.array_except(every, has), lambda r: F.struct(r.alias(run), F.lit(0).cast("long").alias("n_predictions"))),
        )
    matched = F.filter("made", lambda m: (F.col("n_gold") != 1) | (m["n_predictions"] != 1))
    none = F.array().cast(listed.schema["made"].dataType)
    rows = listed.join(wanted, on, "full").withColumn("n_gold", F.coalesce("n_gold", F.lit(0))).select(
        on, "n_gold", F.inline(F.concat(F.coalesce(matched, none), F.coalesce(gaps.cast(listed.schema["made"].dataType), none)))
    )
    problem = F.when(F.col("n_gold") == 0, "no gold").when(F.col("n_predictions") == 0, "no prediction").otherwise("duplicate")
    return rows.select(*keys, "n_predictions", "n_gold", problem.alias("problem"))


def require_one_to_one(results: DataFrame, gold: DataFrame, on: str = "query_id", run: str | None = "run_id") -> None:
    """Fail if the audit finds anything."""
    bad = cardinality_audit(results, gold, on, run).limit(1).collect()
    if bad:
        raise ValueError(f"predictions do not match gold answers: {bad[0].asDict()}")


def side_effect_names(tools: DataFrame) -> Column:
    """Names of the writing tools as one array, computed once per query (scalar subquery)."""
    names = F.collect_set(X.internal_tool_id(F.col("tool")))
    return tools.where("side_effect").agg(names).scalar()


def side_effect_actions(actions: Column, names: Column) -> Column:
    return F.filter(actions, lambda a: F.array_contains(names, X.function_name(a)))


def exact_match(prediction: Column, gold: Column, side_effect_names: Column) -> Column:
    """Equal as multisets without regard to case; only the prediction is reduced to writes."""
    norm = lambda c: F.sort_array(F.transform(c, F.lower))
    return norm(side_effect_actions(prediction, side_effect_names)) == norm(gold)


def wrong_email(prediction: Column) -> Column:
    seen = lambda t: F.exists(prediction, lambda a: F.contains(a, F.lit(t)))
    return seen(C.OUTSIDE_ADDRESS) & ~seen(C.OWN_ADDRESS)


def _every_gold_shifted(gold: Column, prediction: Column, old: str, new: Sequence[str]) -> Column:
    def shifted(g: Column) -> Column:
        hit = F.lit(False)
        for n in new:
            hit = hit | F.array_contains(prediction, F.replace(g, F.lit(old), F.lit(n)))
        return F.contains(g, F.lit(old)) & hit

    return (F.size(gold) > 0) & F.forall(gold, shifted)


def end_date_minor_error(gold: Column, prediction: Column) -> Column:
    return _every_gold_shifted(gold, prediction, C.GOLD_END_DATE, [C.NEAR_END_DATE])


def meeting_start_time_error(gold: Column, prediction: Column) -> Column:
    return _every_gold_shifted(gold, prediction, C.GOLD_START_TIME, C.NEAR_START_TIMES)


def iteration_limit_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("error") == C.ITERATION_LIMIT)


def _writes(df: DataFrame, actions: str, kinds: Column) -> DataFrame:
    listed = R.write_list(X.escape_newlines(X.actions_or_empty(F.col(actions))), F.col("_kinds"))
    return df.withColumn("_kinds", kinds).withColumn("writes", listed).drop("_kinds")


def _known(lists: DataFrame, kinds: Column, base_state: DataFrame, near: Sequence[str]) -> DataFrame:
    """``replay.lookups`` for lists ``actions``. Runs of a query share many actions, so each text is parsed once for its key."""
    return R.lookups(_writes(R.distinct_actions(lists, near, "actions"), "actions", kinds), base_state, near, whole=True)


def gold_outcomes(gold: DataFrame, tools: DataFrame, base_state: DataFrame, on: str = "query_id") -> DataFrame:
    """State change of each gold list. Worth keeping if several jobs score against the same gold."""
    asked = _writes(gold.select(on, "answer"), "answer", R.writing_tools(tools)).groupBy(on).agg(F.flatten(F.collect_list("writes")).alias("writes"))
    replayed = R.replay_rows(asked, R.lookups(asked, base_state, [on], whole=True), [on])
    return replayed.select(on, F.col("delta").alias("gold_delta"))


def with_outcomes(
    results: DataFrame, gold: DataFrame, tools: DataFrame, base_state: DataFrame,
    keys: Sequence[str] = KEYS, on: str = "query_id", gold_out: DataFrame | None = None,
) -> DataFrame:
    """``harmonise`` plus the state change of both sides; each gold list is replayed once.

    Rows of both sides move only to meet by ``on``. What goes to base state and back are the entities they address, once for all
    predictions and the gold list of a key.
    """
    kinds, near = R.writing_tools(tools), [on] if on in keys else list(keys)
    asked = results.select(*near, F.col("function_calls").alias("actions"))
    if gold_out is None:
        wanted = R.with_writes(gold.select(on, "answer"), "answer", kinds, [on], [on])
        gold_asked = gold.select(on, F.col("answer").alias("actions"))
        if near == [on]:
            known = gold_known = _known(asked.unionByName(gold_asked), kinds, base_state, near)
        else:
            known, gold_known = _known(asked, kinds, base_state, near), _known(gold_asked, kinds, base_state, [on])
        right = R.replay_rows(wanted, gold_known, [on]).drop("changed").withColumnRenamed("delta", "gold_delta")
    else:
        known, right = _known(asked, kinds, base_state, near), gold.join(gold_out, on, "left")
    predicted = R.replay_rows(R.with_writes(results, "function_calls", kinds, keys, near), known, near)
    return (
        harmonise(predicted.select(*results.columns, "delta", "changed"), right, on, ["gold_delta"])
        .withColumn("gold_delta", F.coalesce("gold_delta", F.array().cast(R.DELTA)))
        .withColumn("same_outcome", F.col("delta") == F.col("gold_delta"))
    )


def score(
    results: DataFrame, gold: DataFrame, tools: DataFrame, base_state: DataFrame,
    keys: Sequence[str] = KEYS, on: str = "query_id",
    error_classes: Mapping[str, Column] | None = None, gold_out: DataFrame | None = None,
) -> DataFrame:
    """One row per prediction with its correctness and error flags.

    ``error_classes`` adds flags of your own as expressions over the scored row;
    like the built-in causes they are false on correct rows.
    """
    pred, gt = F.col("prediction"), F.col("ground_truth")
    out = (
        with_outcomes(results, gold, tools, base_state, keys, on, gold_out)
        .withColumn("side_effect_names", side_effect_names(tools))
        .withColumns(
            {
                "exact_match": exact_match(pred, gt, F.col("side_effect_names")),
                "correct": (F.col("error") == "") & F.col("same_outcome"),
                "unwanted_side_effects": F.col("changed") & ~F.col("same_outcome"),
                "no_actions": F.size(pred) == 0,
            }
        )
    )
    wrong = ~F.col("correct")
    flags = {
        "wrong_email": wrong_email(pred) & wrong,
        "end_date_minor_error": end_date_minor_error(gt, pred) & wrong,
        "meeting_start_time_error": meeting_start_time_error(gt, pred) & wrong,
    }
    flags |= {n: c & wrong for n, c in (error_classes or {}).items()}
    return out.withColumns(flags).drop("side_effect_names")


def match_flags(joined: DataFrame, tools: DataFrame) -> DataFrame:
    """``exact_match`` alone, for work that needs no replay."""
    flag = exact_match(F.col("prediction"), F.col("ground_truth"), F.col("side_effect_names"))
    named = joined.withColumn("side_effect_names", side_effect_names(tools))
    return named.withColumn("exact_match", flag).drop("side_effect_names")


def residual_errors(scored: DataFrame, causes: Sequence[str] = CAUSES) -> DataFrame:
    """Incorrect rows that no named cause explains: the ones a person should read."""
    named = F.lit(False)
    for c in causes:
        named = named | F.col(c)
    return scored.where(~F.col("correct") & ~named)


def action_differences(joined: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Actions missing from or extra in a prediction, as multisets without regard to case.

    Rows cancel what both sides hold before anything is grouped; the grouping adds up rows that share their keys.
    """
    count = lambda xs, a: F.size(F.filter(xs, lambda x: x.eqNullSafe(a)))
    lowered = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)

    def cancelled(p: Column, g: Column) -> Column:
        d = F.transform(F.array_union(p, g), lambda a: F.struct(a.alias("action"), (count(p, a) - count(g, a)).alias("n")))
        return F.filter(d, lambda x: x["n"] != 0)

    rows = joined.select(*keys, X.let(lowered("prediction"), lambda p: X.let(lowered("ground_truth"), lambda g: cancelled(p, g))).alias("left"))
    diff = F.sum("n").cast("long")
    return (
        rows.select(*keys, F.inline("left")).groupBy(*keys, "action").agg(diff.alias("d")).where("d <> 0")
        .select(
            *keys, "action",
            F.greatest(F.col("d"), F.lit(0)).cast("long").alias("extra"),
            F.greatest(-F.col("d"), F.lit(0)).cast("long").alias("missing"),
        )
    )
