"""Rates, leaderboards and breakdowns over scored rows.

Every report groups scored rows first; windows only see one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill import constants as C
from tracemill.functions import text as X
from tracemill.operators import replay as R
from tracemill.operators import score as S


def _n(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def accuracy(scored: DataFrame, by: Sequence[str] = ("domain", "config"), flag: str = "correct") -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        _n(F.col(flag)).alias("n_correct"),
        (F.avg(F.col(flag).cast("double")) * 100).alias("accuracy"),
    )


def error_rates(scored: DataFrame, by: Sequence[str] = ("domain", "config")) -> DataFrame:
    """Wrong rows without and with unwanted side effects, as counts and shares of all rows."""
    wrong, side = ~F.col("correct"), F.col("unwanted_side_effects")
    out = scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        _n(wrong & ~side).alias("n_without_side_effects"),
        _n(wrong & side).alias("n_with_side_effects"),
    )
    pct = lambda c: F.col(c) / F.col("n") * 100
    return out.withColumns(
        {
            "pct_without_side_effects": pct("n_without_side_effects"),
            "pct_with_side_effects": pct("n_with_side_effects"),
        }
    )


def leaderboard(acc: DataFrame, configs: Sequence[str], value: str = "accuracy") -> DataFrame:
    """Domains as rows, configurations as columns; a missing score stays null."""
    return acc.groupBy("domain").pivot("config", list(configs)).agg(F.first(value))


def best_per_domain(acc: DataFrame, value: str = "accuracy") -> DataFrame:
    """The best configurations of each domain, all of them on a tie."""
    top = F.max(value).over(W.partitionBy("domain"))
    return acc.withColumn("_top", top).where(F.col(value) == F.col("_top")).drop("_top")


def deltas_to_baseline(acc: DataFrame, baseline: str, value: str = "accuracy") -> DataFrame:
    base = F.max(F.when(F.col("config") == baseline, F.col(value))).over(W.partitionBy("domain"))
    delta = F.col(value) - F.col("baseline")
    trend = F.when(delta > 0, "improved").when(delta < 0, "regressed").when(delta == 0, "equal")
    return (
        acc.withColumn("baseline", base).where(F.col("config") != baseline)
        .withColumns({"delta": delta, "trend": trend})
    )


def totals(acc: DataFrame) -> DataFrame:
    """Per configuration over all domains: weighted by queries, and the plain mean of domains."""
    return acc.groupBy("config").agg(
        F.count("*").alias("n_domains"),
        F.sum("n").cast("long").alias("n"),
        F.sum("n_correct").cast("long").alias("n_correct"),
        (F.sum("n_correct") / F.sum("n") * 100).alias("weighted_accuracy"),
        F.avg("accuracy").alias("mean_accuracy"),
    )


def iteration_limit_share(results: DataFrame, by: Sequence[str] = ("domain", "config")) -> DataFrame:
    hit = F.col("error").eqNullSafe(C.ITERATION_LIMIT)
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), _n(hit).alias("n_limit"),
        F.avg(hit.cast("double")).alias("share"),
    )


def error_classes(
    scored: DataFrame, causes: Sequence[str] = S.CAUSES, by: Sequence[str] = ("domain", "config")
) -> DataFrame:
    """Rows per cause plus the unexplained rest, with subtotals (null = all)."""
    named = F.lit(False)
    for c in causes:
        named = named | F.col(c)
    flags = scored.select(*by, *causes, (~F.col("correct") & ~named).alias("residual"))
    return flags.rollup(*by).agg(
        F.count("*").alias("n"), *[_n(F.col(c)).alias(f"n_{c}") for c in (*causes, "residual")]
    )


def _one_value_apart(a: Column, b: Column) -> Column:
    """Whether two sorted argument lists differ in the value of exactly one argument."""
    apart = F.zip_with(
        a, b,
        # A name that differs counts as two, so such a pair never qualifies.
        lambda x, y: F.when(~x["name"].eqNullSafe(y["name"]), 2).when(x["value"] != y["value"], 1).otherwise(0),
    )
    return F.coalesce(F.aggregate(apart, F.lit(0), lambda s, x: s + x) == 1, F.lit(False))


def repeated_actions(results: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Per trace and function: calls, distinct calls, and calls with a near duplicate, that is
    another call with the same arguments but for the value of one.

    A trace is one row and bounded by the turn limit, so all of this happens
    inside the row, without a shuffle.
    """
    acts = F.transform(
        "function_calls",
        lambda a: F.struct(
            X.function_name(a).alias("function"), a.alias("action"),
            F.sort_array(X.action_args(a)).alias("args"),
        ),
    )

    def summary(f: Column, mine: Column) -> Column:
        near = F.filter(mine, lambda a: F.exists(mine, lambda b: _one_value_apart(a["args"], b["args"])))
        return F.struct(
            f.alias("function"),
            F.size(mine).cast("long").alias("calls"),
            F.size(F.array_distinct(F.transform(mine, lambda a: a["action"]))).cast("long").alias("distinct_calls"),
            F.size(near).cast("long").alias("near_duplicates"),
        )

    def summaries(acts: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(acts, lambda a: a["function"])),
            lambda f: X.let(F.filter(acts, lambda a: a["function"] == f), lambda mine: summary(f, mine)),
        )

    # inline_outer: for inline the optimiser adds a filter that evaluates the array twice.
    rows = results.select(*keys, F.inline_outer(X.let(acts, summaries)))
    return rows.where(F.col("function").isNotNull())


def tool_usage(scored: DataFrame, by: Sequence[str] = ("domain", "config")) -> DataFrame:
    """Calls of each tool, traces that use it, and how many of those are correct."""
    functions = F.transform("prediction", X.function_name)
    # One entry per tool and trace, made inside the row, so nothing is shuffled by trace.
    per_trace = F.transform(
        F.array_distinct("functions"),
        lambda f: F.struct(f.alias("tool"), F.size(F.filter("functions", lambda g: g == f)).alias("n")),
    )
    return (
        scored.select(*by, "correct", functions.alias("functions"))
        .select(*by, "correct", F.inline(per_trace))
        .groupBy(*by, "tool")
        .agg(
            F.sum("n").cast("long").alias("calls"),
            F.count("*").alias("traces"),
            F.avg(F.col("correct").cast("double")).alias("success_rate"),
        )
    )


def rounded(df: DataFrame, places: int = 2) -> DataFrame:
    """Report form: fractions rounded."""
    return df.select(
        *[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
