"""Mixing sources to target weights with a splitting tree.

Sources share the words of all documents by weight. No source may give more than ``cap`` times its size; what is over
goes to the others by weight. Each source's rows are dealt by hash into blocks of about ``block_rows`` rows. A source
whose target is f times its size plus a rest gives all of its blocks f times, and for the rest whole blocks in a
permuted order, of which the last is cut between documents. The blocks given are then split among the output shards:
a tree halves the shards, and at each of its nodes a multivariate hypergeometric draw says how many blocks of each
source go left, so that every shard gets an exact quota of blocks. Blocks fill the quotas in permuted order, disjointly,
and ``mixed_rows`` orders the rows of a shard by a hash.

Only DataFrame and SQL operations touch documents. The driver sees one row per source: its name, words, rows and blocks.

Defined cases: a null text has size 0; a null source is a source of its own and the last in order; documents of size 0
are never taken. Equal rows (doc_id, source, size) are counted together first, so that a row repeated many times is one
row until the end, and each copy then gets its own row. Ties in the permuted order are broken by doc_id. The same input
gives the same result, however it is partitioned. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import through_table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    rows: int
    target: float
    blocks: int


def weighted(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float]) -> list[tuple[str | None, int, float]]:
    """Sources by code point, null last, each with its size and weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    return [(name, size, float(weights[i % len(weights)])) for i, (name, size) in enumerate(order)]


def targets(sized: Sequence[tuple[int, float]], cap: float) -> list[float]:
    """Shares of the sum of all sizes by weight, none above ``cap`` times its size. ``sized``: (size, weight)."""
    found: dict[int, float] = {}
    while True:
        open_ = [i for i in range(len(sized)) if i not in found]
        left = float(sum(s for s, _ in sized)) - sum(found.values())
        weight = sum(sized[i][1] for i in open_)
        share = {i: left * sized[i][1] / weight for i in open_}
        over = [i for i in open_ if share[i] > cap * sized[i][0]]
        if not over:
            return [found.get(i, share.get(i, 0.0)) for i in range(len(sized))]
        found |= {i: cap * float(sized[i][0]) for i in over}


def split_quotas(blocks: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """For each source, how many of its blocks each shard gets: drawn down a tree that halves the shards."""
    out = [[0] * shards for _ in blocks]

    def walk(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            for s, n in enumerate(have):
                out[s][lo] = int(n)
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have
        walk(lo, mid, left)
        walk(mid, hi, have - left)

    if len(blocks):
        walk(0, shards, np.asarray(blocks, dtype=np.int64))
    return out


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table from driver values, without an RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


@dataclass(frozen=True)
class Plan:
    """``rows``: doc_id, source, size, copies, source_size, target, full, block, extra (words and copies of the rest).
    ``placed``: source_id, epoch, block, shard."""

    rows: DataFrame
    placed: DataFrame


def plan(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, block_rows: int = 256, shards: int = 16, seed: int = 7
) -> Plan:
    """Draws the mix. Reads doc_id, source and text of ``docs``."""
    spark = docs.sparkSession
    counted = through_table(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
        .withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "size"))
    )
    per_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows")).collect()
    rows_of = {r["source"]: r["rows"] for r in per_source}
    order = weighted([(r["source"], r["size"]) for r in per_source], weights)
    wanted = targets([(size, w) for _, size, w in order], cap) if order else []
    sources = [Source(name, size, rows_of[name], t, -(-rows_of[name] // block_rows)) for (name, size, _), t in zip(order, wanted)]
    known = _table(
        spark,
        [{"source_id": i, "name": s.name, "source_size": s.size, "target": s.target, "blocks": s.blocks} for i, s in enumerate(sources)],
        "source_id int, name string, source_size bigint, target double, blocks bigint",
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = counted.join(known, counted["source"].eqNullSafe(known["name"])).drop("name").select(
        "*", F.pmod("u", F.col("blocks")).alias("block"), full.alias("full")
    ).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size")))

    # The rest: whole blocks in a permuted order while they fit.
    permuted = lambda epoch: F.xxhash64(F.lit(seed + 1), "source_id", epoch, "block")
    by_order = Window.partitionBy("source_id").orderBy("order", "block")
    block = through_table(
        rows.groupBy("source_id", "block", "full", "rest").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        .withColumn("order", permuted("full"))
        .withColumn("before", F.sum("words").over(by_order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("left", F.col("rest") - F.coalesce("before", F.lit(0)))
    )
    share = rows.join(block.select("source_id", "block", "words", "left"), ["source_id", "block"])
    inside = Window.partitionBy("source_id", "block").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.col("left") > 0) & (F.col("left") < F.col("words"))
    whole = share.where(~cut).withColumn("extra", F.when((F.col("left") > 0) & (F.col("size") > 0), F.col("copies")).otherwise(0))
    part = (
        share.where(cut).withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
        .withColumn(
            "extra",
            F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least("copies", F.floor((F.col("left") - F.col("before")) / F.col("size") + 0.5)))).otherwise(0),
        ).drop("before")
    )
    dealt = whole.withColumn("extra", F.col("extra").cast("long")).unionByName(part.withColumn("extra", F.col("extra").cast("long")))

    # Which shard gets which block: quotas from the tree, filled in permuted order.
    epochs = block.select("source_id", "block", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("epoch"), "full", "left")
    given = epochs.where((F.col("epoch") < F.col("full")) | (F.col("left") > 0)).withColumn("order", permuted("epoch"))
    counts = {r["source_id"]: r["n"] for r in given.groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    quotas = split_quotas([counts.get(i, 0) for i in range(len(sources))], shards, seed)
    ends = _table(
        spark, [{"source_id": i, "ends": np.cumsum(q).tolist()} for i, q in enumerate(quotas)], "source_id int, ends array<bigint>"
    )
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("epoch", "order", "block"))
    placed = (
        given.withColumn("rank", rank).join(ends, "source_id")
        .select("source_id", "epoch", "block", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"))
    )
    return Plan(dealt, placed)


def taken(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words), and the shards that hold it."""
    p = plan(docs, **parameters)
    shards = p.placed.groupBy("source_id", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("epoch", "shard"))).alias("at")  # at most cap + 1 entries
    )
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return (
        p.rows.join(shards, ["source_id", "block"], "left")
        .select("doc_id", "source", "size", "source_size", "target", "full", "extra", "at", copy)
        .withColumn("times", F.when(F.col("size") > 0, F.col("full") + (F.col("copy") <= F.col("extra")).cast("int")).otherwise(0))
        .select(
            "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"),
            F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda e: F.col("at")[e]))
            .otherwise(F.array().cast("array<int>")).alias("shards"),
        )
    )


def mixed_rows(docs: DataFrame, seed: int = 7, **parameters) -> DataFrame:
    """The mix itself: one row for each time a document is taken, with its shard and its place in the shard's order."""
    each = taken(docs, seed=seed, **parameters)
    return each.select("doc_id", "source", "size", F.posexplode("shards").alias("epoch", "shard")).withColumn(
        "place", F.xxhash64(F.lit(seed + 2), "shard", "epoch", "doc_id")
    )


def taken_rows(docs: DataFrame, **parameters) -> DataFrame:
    """As ``taken``, with text_hash: rows that share a doc_id but not a text are drawn one by one."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id")
    each = taken(docs.select(key, "source", "text"), **parameters)
    return each.select("doc_id.doc_id", "doc_id.text_hash", *each.columns[1:])


def drawn(each: DataFrame, docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of the mix with their texts. ``each``: result of ``taken_rows`` on ``docs``."""
    key = ["doc_id", "source", "text_hash"]
    texts = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash")).dropDuplicates(key)
    rows = each.select(*key, F.posexplode("shards").alias("epoch", "shard")).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key]
    place = F.xxhash64(F.lit(seed + 2), "r.shard", "r.epoch", "r.doc_id", "r.text_hash").alias("place")
    return rows.join(texts.alias("t"), same).select("r.doc_id", "t.text", "r.source", "r.epoch", "r.shard", place)
