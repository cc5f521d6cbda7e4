"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouped minimum and a join, written to the shared folder, so that no vertex gathers its neighbours in
one task and a lost executor re-reads files. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import through_table


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a vertex is tied to the least of the vertex and its neighbours."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour below a vertex, and the vertex, is tied to the least of them. Edges have a < b."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    tied = e.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b. Returns node, root for every node of an edge between different nodes; root is the least node."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    seen = None
    while True:
        e = through_table(_small_star(_large_star(e)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
