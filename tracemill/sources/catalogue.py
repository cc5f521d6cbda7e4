"""Small fixed dimensions as DataFrames, and the tool catalogue with its tool sets."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracemill import constants as C
from tracemill import schemas


def rows_as_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A local relation: its exact size is known to the optimiser, which then chooses the join."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)


def catalogue(spark: SparkSession, tools: list[dict]) -> DataFrame:
    """Tool catalogue from plain rows; a new tool is a new row (``op_kind`` read, insert,
    update or delete; ``target`` the state table; ``key_arg`` the argument naming the entity)."""
    rows = [{f: t.get(f) for f in schemas.TOOLS.names} | {"pos": i} for i, t in enumerate(tools)]
    return rows_as_table(spark, rows, schemas.TOOLS)


def toolset_key(domains) -> F.Column:
    """Which of the state domains a query names, in the fixed order: 32 values at most."""
    picked = [F.when(F.array_contains(domains, d), F.lit(d)) for d in C.TOOLSET_ORDER]
    return F.concat_ws("|", *picked)


def toolsets(tools: DataFrame) -> DataFrame:
    """Tools of each of the 32 possible tool sets, in prompt order: ``toolset, ord, tool, ..``."""
    sets = [
        {"toolset": "|".join(s), "domain": d, "rank": (*C.TOOLSET_ORDER, C.DIRECTORY_DOMAIN).index(d)}
        for n in range(len(C.TOOLSET_ORDER) + 1)
        for s in combinations(C.TOOLSET_ORDER, n)
        for d in (*s, C.DIRECTORY_DOMAIN)
    ]
    kind = T.StructType().add("toolset", "string").add("domain", "string").add("rank", T.LongType())
    return rows_as_table(tools.sparkSession, sets, kind).join(tools, "domain")


def toolset_texts(tools: DataFrame) -> DataFrame:
    """``toolset, tools_text, tool_names``: the text form of each tool set."""
    params = F.array_join(
        F.transform(
            "params",
            lambda p: F.concat(
                p["name"], F.lit(" ("), F.coalesce(p["type"], F.lit("any")), F.lit("): "),
                F.coalesce(p["description"], F.lit("")),
            ),
        ),
        "; ",
    )
    line = F.concat(
        F.lit("- "), "tool", F.lit(": "), F.coalesce("description", F.lit("")), F.lit("\n  Arguments: "),
        F.when(F.size("params") > 0, params).otherwise("No arguments."),
    )
    listed = F.sort_array(F.collect_list(F.struct("rank", "pos", line.alias("line"), "tool")))
    return (
        toolsets(tools).groupBy("toolset").agg(listed.alias("l"))
        .select(
            "toolset",
            F.array_join("l.line", "\n").alias("tools_text"),
            F.col("l.tool").alias("tool_names"),
        )
    )
