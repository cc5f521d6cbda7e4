"""Which tools a query may use, and which calls or episodes fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import constants as C
from tracemill.functions import text as X
from tracemill.sources import catalogue as K


def with_toolset(queries: DataFrame, mode: str = "domains") -> DataFrame:
    """Adds the tool set key: the query's own domains, or all five."""
    if mode == "all":
        # Taken together with the query's own domains, so that the key is a column to join on.
        every = F.array(*[F.lit(d) for d in C.TOOLSET_ORDER])
        return queries.withColumn("toolset", K.toolset_key(F.array_union("domains", every)))
    if mode == "domains":
        return queries.withColumn("toolset", K.toolset_key(F.col("domains")))
    raise ValueError(f"unknown tool selection mode: {mode}")


def query_tools(queries: DataFrame, tools: DataFrame, mode: str = "domains") -> DataFrame:
    """One row per query and usable tool, in prompt order; directory tools always belong."""
    sets = K.toolsets(tools).select("toolset", "rank", "pos", "tool", F.col("domain").alias("tool_domain"))
    return with_toolset(queries, mode).join(sets, "toolset")


def with_available(queries: DataFrame, tools: DataFrame, mode: str = "domains") -> DataFrame:
    """Adds ``available``, the names of the usable tools."""
    names = K.toolset_texts(tools).select("toolset", F.col("tool_names").alias("available"))
    return with_toolset(queries, mode).join(names, "toolset")


def fits(used: Column, available: Column) -> Column:
    """Whether all used tools are available."""
    return F.size(F.array_except(used, available)) == 0


def eligible_signatures(episodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of distinct tool signatures where the episode's tools are all available.

    Division by counting: a pair qualifies if it meets on as many tools as the
    episode uses. Only distinct signatures meet, not episodes and queries.
    """
    e = episodes.select(F.sort_array(F.array_distinct("tools")).alias("t")).distinct()
    q = queries.select(F.sort_array(F.array_distinct("available")).alias("a")).distinct()
    e = e.select(F.array_join("t", "|").alias("episode_tools"), F.size("t").alias("n"), F.explode("t").alias("tool"))
    q = q.select(F.array_join("a", "|").alias("query_tools"), F.explode("a").alias("tool"))
    return (
        e.join(q, "tool").groupBy("episode_tools", "query_tools", "n").agg(F.count("*").alias("met"))
        .where("met = n").select("episode_tools", "query_tools")
    )


def unknown_tools(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls whose tool is not in the catalogue. ``calls`` has a ``tool`` column."""
    return calls.join(tools.select("tool"), "tool", "left_anti")


def unavailable_tools(calls: DataFrame, queries: DataFrame, tools: DataFrame, mode: str = "domains") -> DataFrame:
    """Calls whose tool is not in the tool set of their own query."""
    sets = K.toolsets(tools).select("toolset", "tool")
    keyed = calls.join(with_toolset(queries, mode).select("query_id", "toolset"), "query_id")
    return keyed.join(sets, ["toolset", "tool"], "left_anti")


def first_queries(queries: DataFrame, n: int) -> DataFrame:
    """The first ``n`` queries in input order."""
    return queries.orderBy("seq").limit(n)


def parse_domains(queries: DataFrame, column: str = "domains") -> DataFrame:
    return queries.withColumn(column, X.domain_list(F.col(column)))
