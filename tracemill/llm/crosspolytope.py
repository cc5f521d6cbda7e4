"""Near copies among embeddings: all pairs with a cosine of at least a threshold, by cross-polytope hashing.

1. Equal vectors are worked on once, with their number as weight.
2. A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and names the axis that lies nearest to it.
   ``k`` hashes make a bucket, and there are several tables of buckets. A vector lies in one bucket of each table and
   probes the ``probes`` likeliest ones, by what the next best axes lose. ``k`` follows the number of vectors, so that buckets stay
   small; the number of tables follows from it: pairs drawn exactly at the threshold are hashed, and as many tables are taken as bring
   the share of such pairs that meet to ``recall``. Pairs above the threshold meet more often.
3. Dense groups become balls: the mean of a few vectors of a bucket is a centre, and vectors within half the threshold's angle of
   it are a ball. All pairs in a ball are linked by the triangle inequality; none is formed. What meets in buckets are balls and single
   vectors, one entry a bucket however many members a ball has there.
4. Every pair that met is verified in double precision. Two single vectors are compared; two balls are linked as a whole, or not at
   all, if their radii and the angle of their centres decide it; else their members are compared in blocks of at most ``block``, which
   give back link counts by vector, not pairs.

Nothing is collected but the number of vectors by length. Groups of one bucket meet by a plain join, which the adaptive planner splits.

Defined cases: vectors that are null, of length 0, zero, or hold null or non-finite components link with nothing and are their own
component. Vectors of different length are not compared. Rows with equal vectors link with each other, also if they share an id or
have none; a row counts every other row. ``component_id`` is the least vec_id of the component, null ids aside, and null if it has
none. ``kept`` says whether both are equal, two nulls included. Other columns are not read. No link below the threshold is given;
the recall is 1 within balls and at least about ``recall`` at the threshold elsewhere.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import vectors as V
from tracemill.llm.components import components
from tracemill.session import through_table

SLACK = 1e-6
SIGNS = 128


# --- hashing -----------------------------------------------------------------------------


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


@cache
def _flips(d: int, seed: int) -> np.ndarray:
    width = 1 << max(0, (d - 1).bit_length())
    return np.where(np.random.default_rng((d, seed)).random((3, width)) < 0.5, -1.0, 1.0)


def rotated(m: np.ndarray, seed: int) -> np.ndarray:
    """Rows padded to a power of two and turned at random, by three rounds of signs and Hadamard transforms."""
    flips = _flips(m.shape[1], seed)
    x = np.zeros((len(m), flips.shape[1]))
    x[:, : m.shape[1]] = m
    for f in flips:
        x = hadamard(x * f)
    return x


def buckets(m: np.ndarray, k: int, table: int, probes: int) -> np.ndarray:
    """The ``probes`` likeliest buckets of every row in a table, its own first; -1 where there are fewer."""
    width = 1 << max(0, (m.shape[1] - 1).bit_length())
    best = min(probes, width)
    codes, losses = [], []
    for j in range(k):
        y = rotated(m, 1 + table * 64 + j)
        at = np.argpartition(-np.abs(y), best - 1, axis=1)[:, :best] if best < width else np.tile(np.arange(width), (len(y), 1))
        v = np.take_along_axis(y, at, 1)
        order = np.argsort(-np.abs(v), axis=1, kind="stable")
        at, v = np.take_along_axis(at, order, 1), np.take_along_axis(v, order, 1)
        codes.append(at * 2 + (v < 0))
        losses.append(np.abs(v[:, :1]) - np.abs(v))
    # A combination can only be among the best if all that dominate it are.
    ways = [w for w in itertools.product(range(best), repeat=k) if math.prod(i + 1 for i in w) <= probes]
    loss = np.stack([sum(losses[j][:, w[j]] for j in range(k)) for w in ways], axis=1)
    name = np.stack([sum((codes[j][:, w[j]].astype(np.int64) + 1) * (2 * width + 1) ** j for j in range(k)) for w in ways], axis=1)
    order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    name = np.take_along_axis(name, order, 1)
    return name if name.shape[1] == probes else np.pad(name, ((0, 0), (0, probes - name.shape[1])), constant_values=-1)


def signs(m: np.ndarray) -> np.ndarray:
    """Signs of the rotated rows, as two numbers a row; 0 for short vectors, whose rotations are too few."""
    if m.shape[1] < 32:
        return np.zeros((len(m), 2), np.int64)
    bits = np.hstack([rotated(m, 2**31 - s)[:, :SIGNS] for s in range(1, 1 + max(1, SIGNS // m.shape[1]))])[:, :SIGNS] > 0
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


def most_differing(cosine: float) -> int:
    """Signs in which pairs at the threshold differ, and five standard deviations more."""
    p = math.acos(cosine) / math.pi
    return math.floor(SIGNS * p + 5 * math.sqrt(SIGNS * p * (1 - p)))


def _pairs_at(d: int, cosine: float, n: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(d)
    x, z = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    length = np.linalg.norm(z, axis=1)[:, None]
    z = np.divide(z, length, out=np.zeros_like(z), where=length > 1e-12)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    return x, y / np.linalg.norm(y, axis=1)[:, None]


def layout(d: int, n: int, cosine: float, recall: float, probes: int, full: int = 16, most_tables: int = 24) -> tuple[int, int]:
    """Hashes in a bucket and number of tables for ``n`` vectors of length ``d``."""
    width = 1 << max(0, (d - 1).bit_length())
    wanted = max(1, math.ceil(math.log(max(n / full, 1.0)) / math.log(2 * width)))
    x, y = _pairs_at(d, cosine)
    for k in range(min(wanted, 8), 0, -1):
        bx, by = buckets(x, k, 0, probes), buckets(y, k, 0, probes)
        met = float(((bx == by[:, :1]).any(1) | (by == bx[:, :1]).any(1)).mean())
        tables = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met)) if met > 0 else most_tables + 1
        if tables <= most_tables or k == 1:
            break
    # Short vectors have few different rotations, so further tables repeat earlier ones.
    return k, min(tables, most_tables)


# --- vectors -----------------------------------------------------------------------------


def _units(packed: pd.Series, kind: np.dtype) -> np.ndarray:
    """Rows of unit length, in double precision."""
    m = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    m = m / np.abs(m).max(1)[:, None]
    return m / np.linalg.norm(m, axis=1)[:, None]


def _by_length(b: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    for _, part in b.groupby(b[column].str.len(), sort=False):
        yield part


def _given(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """row, vec_id, v: all rows with a key of their own; v is packed, or null where a vector links with nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.full(b.num_rows, None, object)
            for at, m in V.finite(b.column("embedding")):
                some = np.abs(m).max(1) > 0
                v[at[some]] = V.packed(m[some].astype(kind)).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(v, pa.binary())], names=["row", "vec_id", "v"])

    keyed = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return through_table(keyed.mapInArrow(pack, "row long, vec_id long, v binary"))


def _hashed(nodes: DataFrame, plan: dict[int, tuple[int, int]], probes: int, kind: np.dtype) -> DataFrame:
    """Adds the buckets of all tables, one table after the other, and the signs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _by_length(b, "v"):
                m = _units(part["v"], kind)
                k, tables = plan[m.shape[1]]
                names = np.hstack([buckets(m, k, t, probes) for t in range(tables)])
                yield part.assign(d=np.int32(m.shape[1]), buckets=list(names), home=names[:, 0], signs=list(signs(m)))

    return nodes.mapInPandas(run, "node long, v binary, copies long, least long, d int, buckets array<long>, home long, signs array<long>")


def _placed(hashed: DataFrame, half: float, kind: np.dtype, sample: int = 16) -> tuple[DataFrame, DataFrame]:
    """Nodes with the ball they belong to, and the balls; a node outside of balls is a ball of its own.

    A centre is the mean of the first ``sample`` nodes of a bucket in hash order. That bounds a centre's cost, not who may belong.
    """
    first = Window.partitionBy("d", "home").orderBy(F.xxhash64("node"), "node")
    few = hashed.select("d", "home", "node", "v").withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample)
    listed = few.groupBy("d", "home").agg(F.min("node").alias("lead"), F.sort_array(F.collect_list("v")).alias("vs")).where(F.size("vs") > 1)

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means = [_units(pd.Series(list(vs)), kind).mean(0) for vs in b["vs"]]
            lengths = [np.linalg.norm(c) for c in means]
            yield pd.DataFrame({
                "d": b["d"], "home": b["home"], "ball": -1 - b["lead"],
                "c": [(c / s).tobytes() if s > 0.1 else None for c, s in zip(means, lengths)],
            })

    centres = listed.mapInPandas(centre, "d int, home long, ball long, c binary").where("c is not null")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _by_length(b, "v"):
                x = _units(part["v"], kind)
                c = np.frombuffer(b"".join(part["c"]), np.float64).reshape(x.shape)
                angle = np.arccos(np.clip((x * c).sum(1), -1, 1))
                yield part.assign(angle=angle)[["node", "ball", "angle", "c"]][angle <= half]

    met = hashed.select("d", "home", "node", "v").join(centres, ["d", "home"])
    inside = through_table(met.mapInPandas(near, "node long, ball long, angle double, c binary"))
    sized = inside.groupBy("ball").agg(F.count("*").alias("n"), F.max("angle").alias("r"), F.first("c").alias("c")).where("n > 1")
    placed = hashed.join(inside.join(sized.select("ball"), "ball", "left_semi").select("node", "ball"), "node", "left")
    placed = through_table(placed.withColumn("ball", F.coalesce("ball", "node")))
    weights = placed.groupBy("ball").agg(F.sum("copies").alias("w"), F.min("least").alias("least"), F.first("d").alias("d"))
    alone = placed.where("ball >= 0").select("ball", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("r"), F.lit(None).cast("binary").alias("c"), F.col("v").alias("own"))
    balls = sized.withColumn("own", F.lit(None).cast("binary")).unionByName(alone).join(weights, "ball")
    return placed, through_table(balls)


# --- pairs -------------------------------------------------------------------------------


def _met(placed: DataFrame, probes: int, cosine: float) -> DataFrame:
    """Pairs a < b of balls that lie in a bucket of each other's probes and may be linked by their signs."""
    both = [F.col("signs")[j].alias(f"s{j}") for j in (0, 1)]
    entry = placed.select("ball", "d", *both, F.posexplode("buckets").alias("pos", "bucket")).where("bucket >= 0")
    entry = entry.select(
        "ball", "d", F.expr(f"pos div {probes}").cast("int").alias("t"), "bucket", (F.col("pos") % probes == 0).alias("own"), "s0", "s1"
    )
    # A ball is in a bucket once, whoever of its members is there.
    once = entry.where("ball < 0").groupBy("ball", "d", "t", "bucket").agg(
        F.max("own").alias("own"), F.first("s0").alias("s0"), F.first("s1").alias("s1")
    )
    entry = through_table(entry.where("ball >= 0").unionByName(once))
    i = entry.where("own").select("d", "t", "bucket", F.col("ball").alias("i"), F.col("s0").alias("i0"), F.col("s1").alias("i1"))
    q = entry.select("d", "t", "bucket", F.col("ball").alias("q"), F.col("s0").alias("q0"), F.col("s1").alias("q1"))
    differ = lambda j: F.bit_count(F.col(f"i{j}").bitwiseXOR(F.col(f"q{j}")))
    close = differ(0) + differ(1) <= most_differing(cosine)
    met = i.join(q, ["d", "t", "bucket"]).where((F.col("i") != F.col("q")) & (close | (F.col("i") < 0) | (F.col("q") < 0)))
    return met.select(F.least("i", "q").alias("a"), F.greatest("i", "q").alias("b")).distinct()


def _judged(pairs: DataFrame, balls: DataFrame, cosine: float, kind: np.dtype) -> DataFrame:
    """a, b, sure: pairs that are linked as a whole (sure) or whose members have to be compared."""
    side = lambda x: balls.select(F.col("ball").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("r", "c", "own")])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    limit = math.acos(cosine)

    def centres(b: pd.DataFrame, x: str) -> np.ndarray:
        own = b[f"{x}_own"].notna().to_numpy()
        out = np.empty(len(b), object)
        if own.any():
            out[own] = [r.tobytes() for r in _units(b[f"{x}_own"][own], kind)]
        out[~own] = b[f"{x}_c"][~own]
        return np.frombuffer(b"".join(out), np.float64).reshape(len(b), -1)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["a_own"].str.len() * (8 // kind.itemsize)
            for _, b in batch.groupby(length.fillna(batch["a_c"].str.len()), sort=False):
                cos = (centres(b, "a") * centres(b, "b")).sum(1)
                angle, radii = np.arccos(np.clip(cos, -1, 1)), (b["a_r"] + b["b_r"]).to_numpy()
                single = (b["a_own"].notna() & b["b_own"].notna()).to_numpy()
                sure = np.where(single, cos >= cosine, angle + radii <= limit - SLACK)
                open_ = ~single & ~sure & (angle - radii <= limit + SLACK)
                yield b.assign(sure=sure)[["a", "b", "sure"]][sure | open_]

    return through_table(met.mapInPandas(judge, "a long, b long, sure boolean"))


def _compared(unsure: DataFrame, placed: DataFrame, balls: DataFrame, cosine: float, block: int, kind: np.dtype) -> DataFrame:
    """node, links and the pair of balls, for the members of pairs of balls that are linked in part."""
    named = unsure.select(F.col("a").alias("ball")).unionByName(unsure.select(F.col("b").alias("ball"))).distinct()
    members = placed.join(named.join(balls.select("ball", "n"), "ball"), "ball")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)).cast("int")
    packed = through_table(
        members.withColumn("part", part).repartition("ball", "part").groupBy("ball", "part").agg(F.sort_array(F.collect_list(F.struct("node", "copies", "v"))).alias("m"))
    )
    side = lambda x: packed.select(F.col("ball").alias(x), F.col("m").alias(f"{x}_m"))
    met = unsure.join(side("a"), "a").join(side("b"), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, am, bm in zip(batch["a"], batch["b"], batch["a_m"], batch["b_m"]):
                sides = [tuple(zip(*((r["node"], r["copies"], r["v"]) for r in m))) for m in (am, bm)]
                x, y = (_units(pd.Series(s[2]), kind) for s in sides)
                hit = x @ y.T >= cosine
                links = np.r_[hit @ np.array(sides[1][1], np.int64), np.array(sides[0][1], np.int64) @ hit]
                some = links > 0
                if some.any():
                    yield pd.DataFrame({"node": np.array(sides[0][0] + sides[1][0], np.int64)[some], "links": links[some], "a": a, "b": b})

    return through_table(met.mapInPandas(compare, "node long, links long, a long, b long"))


def linked(rows: DataFrame, cosine: float = 0.9, recall: float = 0.97, probes: int = 8, block: int = 1024) -> DataFrame:
    """``rows``: vec_id, embedding. Returns vec_id, n_links, component_id, kept: one row for each row."""
    kind = np.dtype(np.float32 if rows.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64)
    given = _given(rows, kind)
    nodes = given.where("v is not null").groupBy("v").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = through_table(nodes.select("node", "v", "copies", "least"))
    lengths = {r["size"] // kind.itemsize: r["n"] for r in nodes.groupBy(F.length("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    plan = {d: layout(d, n, cosine, recall, probes) for d, n in lengths.items()}
    hashed = through_table(_hashed(nodes, plan, probes, kind))
    # All pairs of a ball are linked: two members are at most twice this apart.
    placed, balls = _placed(hashed, (math.acos(cosine) - SLACK) / 2, kind)
    judged = _judged(_met(placed, probes, cosine), balls, cosine, kind)
    parts = _compared(judged.where("not sure"), placed, balls, cosine, block, kind)

    weight = lambda x, y: judged.where("sure").select(F.col(x).alias("ball"), F.col(y).alias("other"))
    other = balls.select(F.col("ball").alias("other"), F.col("w").alias("other_w"))
    whole = weight("a", "b").unionByName(weight("b", "a")).join(other, "other").groupBy("ball").agg(F.sum("other_w").alias("whole"))
    edges = judged.where("sure").select("a", "b").unionByName(parts.select("a", "b"))
    roots = components(edges)
    rooted = balls.select("ball", "w", "least").join(roots.withColumnRenamed("node", "ball"), "ball", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "ball"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_ball = rooted.join(least, "root").join(whole, "ball", "left").select("ball", "w", "component_id", F.coalesce("whole", F.lit(0)).alias("whole"))
    inside = parts.groupBy("node").agg(F.sum("links").alias("inside"))
    of_node = placed.select("node", "v", "ball").join(of_ball, "ball").join(inside, "node", "left").select(
        "v", "component_id", (F.col("w") - 1 + F.col("whole") + F.coalesce("inside", F.lit(0))).cast("long").alias("n_links")
    )
    out = given.join(of_node, "v", "left")
    alone = F.col("v").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
