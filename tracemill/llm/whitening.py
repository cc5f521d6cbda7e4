"""Whitening of embeddings, with the principal components found by QDWH spectral divide and conquer.

Components of vectors become whole numbers ``x = floor(scale * c)``. The fit list is each distinct x vector once. Three passes read
it: exact sums S, the covariance (centred by S / n before multiplying), and the covariance of the whitened values, which is the
check. Every pass folds the rows of a task into one small matrix before anything is shuffled.

The eigenvectors come from the d x d covariance alone. The polar factor U of the shifted matrix V - sI = U H is found by the dynamically
weighted Halley iteration in its QR form; (U + I) / 2 is then the spectral projector on the eigenvalues above s. An orthonormal basis
of the projector's range and of its complement splits V into two smaller matrices, and each is split again until single components
are left. The projection of the rows is one product with a d x 4 matrix, which every task holds.

Bounded: the driver and each task hold d x d numbers, d being the length of the vectors, never rows. Distinct vectors are found by
one shuffle of packed vectors; repeated ones are folded before it.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as are entries of 2^62 / scale and more. The fit is that of the length which most
rows have (of equally frequent ones the longest); rows of another length have no place in it and are dropped too, as are empty
vectors. A component without variance (up to rounding, relative to the largest) whitens to null and takes no part in the check; with a
trace of 0, ``explained`` is null. Equal eigenvalues have no fixed order of their vectors. Fewer than ``top`` dimensions give
fewer components. ``deviation`` is exact; where it does not fit a long it is null. Rows that repeat an id or have none are rows like
others. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import vectors
from tracemill.session import through_table

EPS = np.finfo(np.float64).eps
LARGEST = 2.0**62


# --- eigenvectors of a symmetric matrix --------------------------------------------------


def polar(a: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations.

    Directions that the matrix maps to 0 up to rounding keep a factor between -1 and 1.
    """
    n = len(a)
    size = np.linalg.norm(a)
    if not size:
        return np.zeros_like(a)
    x = a / size
    # A lower bound of the least singular value; too small a bound costs a round, not the result.
    low = EPS
    for _ in range(rounds):
        d = np.cbrt(4.0 * (1.0 - low * low) / low**4)
        root = np.sqrt(1.0 + d)
        wa = root + 0.5 * np.sqrt(max(8.0 - 4.0 * d + 8.0 * (2.0 - low * low) / (low * low * root), 0.0))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2.0
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (wa + wb * low * low) / (1.0 + wc * low * low))
        if low > 1.0 - 1e-14:
            low = 1.0
            if moved <= n * 4.0 * EPS:
                break
    return x


def _range_basis(p: np.ndarray, k: int) -> np.ndarray:
    """Orthonormal n x n matrix whose first k columns span the range of the projector ``p``."""
    n = len(p)
    # Subspace iteration from the k columns that a pivoted Gram-Schmidt pass finds most independent.
    left, chosen = p.copy(), []
    for _ in range(k):
        norms = (left * left).sum(0)
        j = int(np.argmax(norms))
        chosen.append(j)
        v = left[:, j] / np.sqrt(max(norms[j], np.finfo(float).tiny))
        left -= np.outer(v, v @ left)
    q, _ = np.linalg.qr(p[:, chosen])
    q, _ = np.linalg.qr(p @ q)
    full, _ = np.linalg.qr(np.hstack([q, np.eye(n)]))
    full[:, :k] = q
    return full[:, :n]


def _rotated_pair(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a symmetric 2 x 2 matrix by one rotation."""
    if a[0, 1] == 0.0:
        return np.eye(2)
    t = (a[1, 1] - a[0, 0]) / (2.0 * a[0, 1])
    t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
    c = 1.0 / np.hypot(1.0, t)
    return np.array([[c, t * c], [-t * c, c]])


def _split(a: np.ndarray, floor: float) -> np.ndarray:
    """Orthonormal eigenvectors (columns) of a symmetric matrix; off-diagonals up to ``floor`` count as 0."""
    n = len(a)
    off = a - np.diag(np.diag(a))
    if n == 1 or np.abs(off).max() <= floor:
        return np.eye(n)
    if n == 2:
        return _rotated_pair(a)
    diagonal = np.sort(np.diag(a))
    # The median first; if all eigenvalues are on one side of a shift, other shifts follow.
    low, high = diagonal[0] - np.abs(off).sum(0).max(), diagonal[-1] + np.abs(off).sum(0).max()
    shift = (diagonal[(n - 1) // 2] + diagonal[n // 2]) / 2.0
    for _ in range(200):
        u = polar(a - shift * np.eye(n))
        p = (u + np.eye(n)) / 2.0
        k = int(round(np.trace(p)))
        if 0 < k < n:
            q = _range_basis(p, k)
            b = q.T @ a @ q
            if np.abs(b[:k, k:]).max() <= max(floor, n * 8.0 * EPS * np.linalg.norm(a)):
                upper = _split((b[:k, :k] + b[:k, :k].T) / 2.0, floor)
                lower = _split((b[k:, k:] + b[k:, k:].T) / 2.0, floor)
                return np.hstack([q[:, :k] @ upper, q[:, k:] @ lower])
            # An eigenvalue sits on the shift: its direction belongs to neither side.
            shift += (high - shift) * 0.0137
        elif k == 0:
            high = shift
            shift = (low + high) / 2.0
        else:
            low = shift
            shift = (low + high) / 2.0
        if high - low <= floor:
            break
    # All eigenvalues are equal up to rounding.
    return np.eye(n)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns; the largest entry of each vector is positive."""
    v = (v + v.T) / 2.0
    floor = 2.0 * EPS * np.linalg.norm(v)
    q = _split(v, floor)
    # One more split in the basis found takes out what rounding has left.
    rest = q.T @ v @ q
    q = q @ _settled((rest + rest.T) / 2.0, floor)
    q, r = np.linalg.qr(q)
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    q, values = q[:, order], values[order]
    at = np.abs(q).argmax(0)
    return values, q * np.where(q[at, np.arange(len(at))] < 0, -1.0, 1.0)


def _settled(a: np.ndarray, floor: float, sweeps: int = 4) -> np.ndarray:
    """Rotations of the pairs of an almost diagonal matrix whose off-diagonal entry is above ``floor``."""
    n, q = len(a), np.eye(len(a))
    for _ in range(sweeps):
        pairs = np.argwhere(np.abs(np.triu(a, 1)) > floor)
        if not len(pairs):
            break
        for i, j in pairs:
            g = _rotated_pair(a[np.ix_([i, j], [i, j])])
            a[:, [i, j]] = a[:, [i, j]] @ g
            a[[i, j], :] = g.T @ a[[i, j], :]
            q[:, [i, j]] = q[:, [i, j]] @ g
    return q


# --- passes over the rows ----------------------------------------------------------------


def _packed(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, d, x: the usable vectors as whole numbers, packed as int64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in vectors.finite(b.column("embedding")):
                x = np.floor(scale * m)
                fits = np.abs(x).max(1) < LARGEST
                x = x[fits].astype(np.int64)
                d = pa.array(np.full(len(x), m.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at[fits])), d, vectors.packed(x)], names=["vec_id", "d", "x"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack, "vec_id long, d int, x binary")


def _matrix(x: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.int64).reshape(len(x), d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows of the fit list, and its exact sums by dimension."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(d, object)
        for b in batches:
            if len(b):
                m = _matrix(b["x"], d)
                small = int(np.abs(m).max()) * len(m) < 2**62
                total = total + (m.sum(0).astype(object) if small else m.astype(object).sum(0))
                n += len(m)
        if n:
            yield pd.DataFrame({"at": np.arange(-1, d), "total": [str(v) for v in [n, *total]]})

    got = fit.mapInPandas(fold, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by = {r["at"]: int(r["total"]) for r in got.collect()}
    return by.get(-1, 0), [by.get(i, 0) for i in range(d)]


def _covariance(fit: DataFrame, d: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Each task folds its rows into one matrix; the matrices are added row by row, in tasks."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, least = np.zeros((d, d)), None
        for b in batches:
            if len(b):
                c = _matrix(b["x"], d).astype(np.float64) - mean
                total += c.T @ c
                first = bytes(min(b["x"]))
                least = first if least is None else min(least, first)
        if least is not None:
            yield pd.DataFrame({"at": np.arange(d), "first": [least] * d, "line": [r.tobytes() for r in total]})

    def add(key, b: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, so that reruns over the same tasks agree.
        lines = b.sort_values("first", kind="stable")["line"]
        line = np.sum([np.frombuffer(v, np.float64) for v in lines], axis=0)
        return pd.DataFrame({"at": [int(key[0])], "line": [line.tobytes()]})

    lines = fit.mapInPandas(fold, "at int, first binary, line binary").groupBy("at").applyInPandas(add, "at int, line binary").collect()
    v = np.zeros((d, d))
    for r in lines:
        v[r["at"]] = np.frombuffer(r["line"], np.float64)
    return v / n


def _identity_error(fit: DataFrame, d: int, mean: np.ndarray, weights: np.ndarray) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity."""
    k = weights.shape[1]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, at, m2 = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if len(b):
                w = (_matrix(b["x"], d).astype(np.float64) - mean) @ weights
                c = w - w.mean(0)
                n, at, m2 = _merged((n, at, m2), (len(w), w.mean(0), c.T @ c))
        if n:
            yield pd.DataFrame({"n": [n], "at": [at.tobytes()], "m2": [m2.tobytes()]})

    total = (0, np.zeros(k), np.zeros((k, k)))
    # One row of k * (k + 1) numbers from each task.
    for r in fit.mapInPandas(fold, "n long, at binary, m2 binary").toLocalIterator():
        total = _merged(total, (r["n"], np.frombuffer(r["at"], np.float64), np.frombuffer(r["m2"], np.float64).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


def _merged(a: tuple, b: tuple) -> tuple:
    """Joins number, mean and centred products of two sets of rows."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, scale: int = 256, top: int = 4) -> DataFrame:
    """``rows``: vec_id, embedding. Returns vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    x = through_table(_packed(rows, scale))
    lengths = x.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    d = int(lengths["d"])
    x = x.where(F.col("d") == d)
    fit = through_table(x.select("x").distinct())
    n, sums = _sums(fit, d)
    mean = np.array([s / n for s in sums], np.float64)
    v = _covariance(fit, d, n, mean)
    values, axes = eigen(v)
    k, trace = min(top, d), float(np.trace(v))
    alive = values[:k] > d * EPS * max(float(values[0]), 0.0)
    weights = axes[:, :k][:, alive] / np.sqrt(values[:k][alive])
    error = _identity_error(fit, d, mean, weights) if alive.any() else 0.0
    explained = [float(e) / trace if trace > 0 else None for e in values[:k]]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m = _matrix(b["x"], d)
            far = n * int(np.abs(m).max()) + max(map(abs, sums))
            if d * far * far < 2**63:
                c = n * m - np.array(sums, np.int64)
                deviation = pd.Series((c * c).sum(1), dtype="Int64")
            else:
                c = m.astype(object) * n - np.array(sums, object)
                deviation = pd.Series([int(t) if t < 2**63 else None for t in (c * c).sum(1)], dtype="Int64")
            w = np.full((len(m), k), np.nan)
            w[:, alive] = (m.astype(np.float64) - mean) @ weights
            for j in range(k):
                yield pd.DataFrame({
                    "vec_id": b["vec_id"].astype("Int64"), "component": np.int32(j + 1), "n": n, "deviation": deviation,
                    "whitened": w[:, j] if alive[j] else None, "explained": explained[j], "identity_error": error,
                })

    return x.select("vec_id", "x").mapInPandas(project, RESULT)
