"""Whitening against plain numpy and whole numbers of any size."""

import math

import numpy as np
import pytest

from tracemill.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, x int"


def _want(rows, scale=256):
    """(n, S, distinct rows as matrix, usable rows) by plain Python; all vectors of one length."""
    ok = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in ok})
    return len(fit), [sum(c) for c in zip(*fit)], np.array(fit, float), ok


def _check(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(i, v, "a", 7) for i, v in rows], schema)
    got = whitening.whitened(df).collect()
    n, sums, fit, ok = _want(rows)
    d = fit.shape[1]
    mean = fit.mean(0)
    v = (fit - mean).T @ (fit - mean) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(4, d)
    assert len(got) == len(ok) * k
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / v.trace(), rel=1e-9)
    for j in range(k):
        want = sorted((i is None, i or 0, sum((n * c - s) ** 2 for c, s in zip(x, sums)), tuple((np.array(x) - mean) @ q[:, j : j + 1] / np.sqrt(e[j]))) for i, x in ok)
        have = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, (r.whitened,)) for r in by[j + 1])
        assert [w[:3] for w in want] == [h[:3] for h in have]
        a, b = np.array([w[3] for w in want]), np.array([h[3] for h in have])
        gap = np.diff(e).min() if j + 1 < d else 0
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6, (j, gap)
    return got


def test_against_plain_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]]) for i in range(200)]
    rows += [(5, rows[9][1]), (None, rows[9][1]), (900, rows[0][1])] * 3
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 4), (1002, [math.nan] * 6), (1003, [math.inf] * 6), (1004, [])]
    _check(spark, rows)


def test_given_table(spark):
    from conftest import SF

    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    _check(spark, [(r.vec_id, [float(c) for c in r.embedding]) for r in df.collect()], "vec_id long, embedding array<float>, component string, x int")


def test_few_dimensions_and_no_variance(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [2.0]), (2, [4.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(abs(r.whitened) for r in one) == pytest.approx([1, 1]) and {r.explained for r in one} == {1.0}
    same = whitening.whitened(spark.createDataFrame([(1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in same)
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True} and flat[0].identity_error < 1e-9


def test_other_lengths_go_and_large_deviations(spark):
    rows = [(i, [float(i), 1.0 + i % 3]) for i in range(6)] + [(7, [1.0, 2.0, 3.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == set(range(6)) and len(got) == 12
    far = whitening.whitened(spark.createDataFrame([(i, [i * 1e12, 1.0]) for i in range(5)], "vec_id long, embedding array<double>"))
    assert {r.vec_id: r.deviation for r in far.collect()}[2] == 0 and {r.deviation for r in far.where("vec_id <> 2").collect()} == {None}


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    spectra = [rng.random(n), np.r_[np.full(n // 2, 2.0), np.ones(n - n // 2)], 10.0 ** -np.arange(n), np.zeros(n), np.ones(n)]
    for e in spectra:
        v = q @ np.diag(e) @ q.T
        v = (v + v.T) / 2
        got, axes = whitening.eigen(v)
        size = np.linalg.norm(v) or 1
        assert np.abs(axes.T @ axes - np.eye(n)).max() < 1e-13
        assert np.abs(v @ axes - axes * got).max() / size < 1e-14 * max(n, 4)
        assert np.abs(got - np.sort(np.linalg.eigvalsh(v))[::-1]).max() / size < 1e-13


def test_polar_gives_the_sign_of_a_symmetric_matrix():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    e, q = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-13
