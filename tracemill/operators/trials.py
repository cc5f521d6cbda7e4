"""Choosing among trials, attempts and drafts of one query, and judging the judges.

Choices are plain aggregates (``min_by`` / ``max_by``), so they combine before the
shuffle and need no window over a query's trials; only the buffer of reflections follows their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import jsontext as J
from tracemill.functions import text as X


def judge_decisions(df: DataFrame, column: str = "judge_text") -> DataFrame:
    """Adds ``success`` and ``reason`` read from the evaluator's text."""
    verdict = J.judge_verdict(F.coalesce(F.col(column), F.lit("")), X.stripped)
    return df.withColumn("_v", verdict).select(*df.columns, "_v.success", "_v.reason")


def verifier_verdict(text: Column) -> Column:
    """True or false by the first verdict line, null if there is none."""
    word = F.upper(F.regexp_extract(text, rf"(?iU)VERDICT:{X.SPACE}*(CORRECT|INCORRECT)\b", 1))
    return F.when(word == "CORRECT", True).when(word == "INCORRECT", False)


def verifier_decisions(df: DataFrame, column: str = "verify_text") -> DataFrame:
    return df.withColumn("verdict", verifier_verdict(F.col(column)))


def _first_or_last(
    df: DataFrame, keys: Sequence[str], order: str, wanted: Column, limit: int | None
) -> DataFrame:
    """The first row that is wanted, else the last row, among orders 1 .. limit."""
    if limit is not None:
        df = df.where(F.col(order) <= max(1, limit))
    row = F.struct(*[c for c in df.columns if c not in keys])
    return (
        df.groupBy(*keys)
        .agg(
            F.min_by(row, F.when(wanted, F.col(order))).alias("first"),
            F.max_by(row, F.col(order)).alias("last"),
        )
        .select(*keys, F.coalesce("first", "last").alias("r"), F.col("first").isNotNull().alias("settled"))
        .select(*keys, "r.*", "settled")
    )


def choose_trial(
    trials: DataFrame, keys: Sequence[str] = ("query_id",), max_trials: int | None = None
) -> DataFrame:
    """First trial judged successful, else the last one. Needs ``trial, success``."""
    return _first_or_last(trials, keys, "trial", F.col("success"), max_trials)


def choose_attempt(
    attempts: DataFrame, keys: Sequence[str] = ("query_id",), num_retries: int | None = None
) -> DataFrame:
    """First attempt that made a call, else the last one. Needs ``trial, calls``."""
    limit = None if num_retries is None else 1 + max(0, num_retries)
    return _first_or_last(attempts, keys, "trial", F.size("calls") > 0, limit)


def choose_draft(
    drafts: DataFrame, checks: DataFrame, keys: Sequence[str] = ("query_id",), rounds: int | None = None
) -> DataFrame:
    """The draft the first CORRECT verdict refers to, else the last correction.

    ``drafts`` are numbered from 0; ``checks`` has ``round`` from 1 and ``verdict``, round r
    judging draft r - 1. An unreadable verdict counts as not correct.
    """
    if rounds is not None:
        top = max(1, rounds)
        drafts, checks = drafts.where(F.col("draft") <= top), checks.where(F.col("round") <= top)
    won = checks.groupBy(*keys).agg(F.min(F.when(F.col("verdict"), F.col("round") - 1)).alias("won"))
    row = F.struct(*[c for c in drafts.columns if c not in keys])
    picked = drafts.join(won, list(keys), "left").where(F.col("won").isNull() | (F.col("draft") <= F.col("won")))
    return (
        picked.groupBy(*keys)
        .agg(F.max_by(row, "draft").alias("r"), F.first("won").isNotNull().alias("verified"))
        .select(*keys, "r.*", "verified")
    )


def reflection_buffer(trials: DataFrame, size: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """The last ``size`` non-empty reflections written before each trial, oldest first.

    One shuffle by query and windows in trial order: each non-empty reflection holds itself and the ``size - 1`` before it, and a
    trial takes what the last of them holds. No row carries more than ``size`` reflections, however many trials a query has.
    """
    keys, none = list(keys), F.array().cast("array<string>")
    if size < 1:
        return trials.withColumn("buffer", none)
    near = trials.withColumn("_text", X.stripped(F.coalesce("reflection", F.lit("")))).withColumn("_said", F.col("_text") != "")
    said = W.partitionBy(*keys, "_said").orderBy("trial").rowsBetween(1 - size, 0)
    before = W.partitionBy(*keys).orderBy("trial").rowsBetween(W.unboundedPreceding, -1)
    held = near.repartition(*keys).withColumn("_held", F.when(F.col("_said"), F.collect_list("_text").over(said)))
    buffer = F.coalesce(F.last("_held", ignorenulls=True).over(before), none)
    return held.withColumn("buffer", buffer).select(*trials.columns, "buffer")


def judge_quality(
    judged: DataFrame, verdict: str, truth: str, by: Sequence[str] = ("config",)
) -> DataFrame:
    """Confusion counts of a judge against the true outcome, with precision and recall."""
    v, t = F.col(verdict), F.col(truth)
    yes = F.coalesce(v, F.lit(False))
    n = lambda c: F.count_if(c).cast("long")
    out = judged.groupBy(*by).agg(
        n(yes & t).alias("tp"), n(yes & ~t).alias("fp"), n(~yes & t).alias("fn"), n(~yes & ~t).alias("tn"),
        n(v.isNull()).alias("n_unreadable"),
    )
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
