"""Near copies among embeddings against all pairs by numpy."""

import math

import numpy as np
import pytest

from tracemill.llm import crosspolytope as C

SCHEMA = "vec_id long, embedding array<double>, component_id string, row int, v string"


def _want(rows, cosine=0.9):
    """Per row: (vec_id, n_links, component_id, kept), by all pairs."""
    unit = []
    for _, v in rows:
        ok = v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        m = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(m / np.linalg.norm(m) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in near[i]:
            root[find(i)] = find(j)
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(least.get(find(i), vec_id), vec_id)
    return [(vec_id, len(near[i]), least.get(find(i)), vec_id == least.get(find(i))) for i, (vec_id, _) in enumerate(rows)]


def _got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)
    return [tuple(r) for r in C.linked(df, **kw).collect()]


def _key(r):
    return tuple((x is None, x or 0) for x in r)


def _around(rng, centre, n, angle):
    """n vectors at about an angle (degrees) from a centre."""
    z = rng.normal(size=(n, len(centre)))
    z -= (z @ centre)[:, None] * centre
    z /= np.linalg.norm(z, axis=1)[:, None]
    return math.cos(math.radians(angle)) * centre + math.sin(math.radians(angle)) * z


@pytest.mark.parametrize("angle", [5, 9, 15, 18])
def test_dense_groups_are_exact(spark, angle):
    rng = np.random.default_rng(angle)
    c = rng.normal(size=(3, 64))
    c /= np.linalg.norm(c, axis=1)[:, None]
    c[1] = _around(rng, c[0], 1, 22)[0]
    m = np.vstack([_around(rng, c[0], 120, angle), _around(rng, c[1], 60, angle), _around(rng, c[2], 30, angle), rng.normal(size=(40, 64))])
    rows = [(int(i) * 3, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [rows[0]] * 5 + [(77, rows[130][1]), (None, rows[130][1])]
    got, want = sorted(_got(spark, rows, block=32), key=_key), sorted(_want(rows), key=_key)
    if angle < 15:
        assert got == want
    else:
        # Pairs near the threshold are found by chance of the hash: none too many, nine tenths at least.
        have, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.9 * all_ <= have <= all_


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [0.0, 5.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (None, None), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [4.0]), (11, [-4.0]), (12, [1e-200, 0.0]), (13, [1e200, 0.0]), (3, [4.0])]
    assert sorted(_got(spark, rows), key=_key) == sorted(_want(rows), key=_key)


def test_empty(spark):
    assert _got(spark, []) == [] and _got(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    x, y = C._pairs_at(64, 0.905, 600)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(np.vstack([x, y, rng.normal(size=(1500, 64))]))]
    got, want = _got(spark, rows), _want(rows)
    assert sum(r[1] for r in want) >= 1200
    have = sum(r[1] for r in got)
    assert 0.95 * 1200 <= have <= sum(r[1] for r in want)
    by = {r[0]: r for r in want}
    assert all(r[1] <= by[r[0]][1] and r[2] >= by[r[0]][2] for r in got)


def test_hadamard_keeps_lengths_and_angles():
    m = np.random.default_rng(2).normal(size=(5, 48))
    r = C.rotated(m, 3)
    assert r.shape == (5, 64) and np.allclose(r @ r.T, m @ m.T)
    h = np.array([[1.0]])
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(C.hadamard(np.eye(8)), h / math.sqrt(8))


def test_probes_are_the_likeliest_buckets():
    m = np.random.default_rng(4).normal(size=(50, 8))
    m /= np.linalg.norm(m, axis=1)[:, None]
    got = C.buckets(m, 2, 0, 4)
    for i in range(50):
        y = [C.rotated(m[i : i + 1], 1 + j)[0] for j in range(2)]
        loss = {}
        for a in range(8):
            for b in range(8):
                code = (a * 2 + (y[0][a] < 0) + 1) + (b * 2 + (y[1][b] < 0) + 1) * 17
                loss[code] = np.abs(y[0]).max() - abs(y[0][a]) + np.abs(y[1]).max() - abs(y[1][b])
        assert set(got[i]) == set(sorted(loss, key=loss.get)[:4])


def test_layout_grows_with_the_table():
    ks = [C.layout(64, n, 0.9, 0.97, 8)[0] for n in (100, 50_000, 5_000_000)]
    assert ks == sorted(ks) and ks[0] == 1 and ks[-1] > 1
