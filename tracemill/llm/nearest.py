"""Exact top-k inner products with a pivot table.

Vectors are rounded to integers and packed into blocks of rows. A fixed set of pivots, drawn by hash from all vectors, is
the table's columns: the distance of every vector to every pivot is worked out once. For a query q and a vector x, each
pivot p gives |d(q,p) - d(x,p)| <= d(q,x); the largest of these is the best lower bound, and with the lengths of q and x
it bounds their inner product from above. In a block, the vectors with the highest bounds are evaluated first, then those
whose bound reaches the k-th score found. The k best of a block are merged per query.

Queries meet vectors block by block, each pair of blocks in a task of its own; no task, group or broadcast grows with
the input but the pivots, whose number is a parameter.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a null id take no part.
Vectors of different length are not compared; empty vectors have the inner product 0. A query is never its own
candidate: rows that share its id are left out, and a query id that occurs in several rows is answered for each of its
vectors and merged. Ties go to the smaller vec_id; an id that occurs several times as a candidate may fill several ranks.
With fewer candidates than k all are returned. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import through_table

LARGEST = float(2**53)


def usable(v: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(ok(x.cast("double")), F.lit(False))), F.lit(False))


def floored(v: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as double."""
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _packed(df: DataFrame, rows: int, count: int) -> DataFrame:
    """One row per block of about ``rows`` vectors of equal length: block, dim, ids and vectors as bytes."""

    def pack(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id", kind="stable")
        # Dealt by row, not by value, so that repeated rows spread; a block may still hold more than asked: cut it.
        out = []
        for at in range(0, len(b), rows):
            p = b.iloc[at : at + rows]
            m = np.array(p["v"].tolist(), dtype=np.int64).reshape(len(p), key[1])
            out.append((int(key[0]), at, int(key[1]), p["vec_id"].to_numpy(np.int64).tobytes(), m.tobytes()))
        return pd.DataFrame(out, columns=["part", "at", "dim", "ids", "m"])

    n = max(1, -(-count // rows))
    return (
        df.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")).withColumn("dim", F.size("v"))
        .groupBy("part", "dim").applyInPandas(pack, "part int, at int, dim int, ids binary, m binary")
    )


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots, as double."""
    d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (x @ p.T)
    return np.sqrt(np.maximum(d, 0.0))


def best_in_block(
    qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, step: int = 512
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: (its place, candidate places, scores), the k best of the block by (score down, id up)."""
    big = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(x).max(initial=0)), 1.0) * max(q.shape[1], 1) >= LARGEST / 4
    fq, fx, fp = q.astype(np.float64), x.astype(np.float64), pivots.astype(np.float64)
    nq, nx = (fq * fq).sum(1), (fx * fx).sum(1)
    dq, dx = _distances(fq, fp), np.ascontiguousarray(_distances(fx, fp).T)
    low, gap = np.empty(len(x)), np.empty(len(x))
    for i in range(len(q)):
        low.fill(0.0)
        for j in range(len(dx)):
            np.subtract(dx[j], dq[i, j], out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        # Slack for rounding: bounds may only err upwards.
        bound = (nq[i] + nx - low * low) / 2
        bound += 1e-6 * (nq[i] + nx) + 1.0
        bound[ids == qid[i]] = -np.inf
        left, take = np.flatnonzero(bound > -np.inf), step
        at, score = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(left):
            # The likeliest first, without sorting the others: most of them fall below the k-th score found.
            c = left
            if take < len(left):
                parted = np.argpartition(-bound[left], take - 1)
                c, left = left[parted[:take]], left[parted[take:]]
            else:
                left = left[:0]
            if big:
                got = x[c] @ q[i]
            else:
                # Picking most rows out costs more than the product with all.
                got = np.rint((fx @ fq[i])[c] if 2 * len(c) > len(fx) else fx[c] @ fq[i]).astype(np.int64)
            if len(at) == k:
                near = got >= score[-1]
                c, got = c[near], got[near]
            at, score = np.r_[at, c], np.r_[score, got]
            keep = np.lexsort((ids[at], -score))[:k]
            at, score = at[keep], score[keep]
            if len(at) == k:
                left = left[bound[left] >= score[-1]]
            take *= 4
        yield i, at, score


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 24, block: int = 8192, query_block: int = 512, seed: int = 3
) -> DataFrame:
    """``vectors`` and ``queries``: vec_id long, v array<long>. Returns query_id, rank, vec_id, score."""
    n_vectors, n_queries = vectors.count(), queries.count()
    x = through_table(_packed(vectors, block, n_vectors))
    q = _packed(queries, query_block, n_queries)
    drawn = vectors.withColumn("u", F.xxhash64(F.lit(seed), "vec_id", "v")).orderBy("u", "vec_id").limit(pivots).select("v").collect()
    by_dim: dict[int, np.ndarray] = {}
    for r in drawn:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    table = {d: np.array(rows, dtype=np.int64) for d, rows in by_dim.items()}
    # Every query block goes to every block of vectors of the same length.
    parts = x.select(F.col("part").alias("xpart"), F.col("at").alias("xat"), "dim")
    sent = q.select("dim", F.col("ids").alias("qids"), F.col("m").alias("qm")).join(parts, "dim")
    pairs = sent.join(x.select(F.col("part").alias("xpart"), F.col("at").alias("xat"), "dim", "ids", "m"), ["xpart", "xat", "dim"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, qids, qm, ids, m in zip(b["dim"], b["qids"], b["qm"], b["ids"], b["m"]):
                qid, xid = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                qv = np.frombuffer(qm, np.int64).reshape(len(qid), dim)
                xv = np.frombuffer(m, np.int64).reshape(len(xid), dim)
                p = table.get(dim, np.zeros((0, dim), np.int64))
                found = list(best_in_block(qid, qv, xid, xv, p, k))
                if found:
                    yield pd.DataFrame({
                        "query_id": np.repeat(qid[[i for i, _, _ in found]], [len(a) for _, a, _ in found]),
                        "vec_id": xid[np.concatenate([a for _, a, _ in found]).astype(np.int64)],
                        "score": np.concatenate([s for _, _, s in found]).astype(np.int64),
                    })

    hits = pairs.select("dim", "qids", "qm", "ids", "m").mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
