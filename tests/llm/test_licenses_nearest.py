"""License scans and top-k search against plain Python."""

import math
import re

import numpy as np
import pytest

from tracemill.llm import licenses, nearest

TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "MIT  License\nmit license", None, "",
    "the mitlicense apache-license; APACHE LICENSE 2.0", "Licensed under the Apache License, Version 2.0", "öl mit Lizenz, general public licenses",
    "SPDX-License-Identifier: LGPL-2.1-only", "permit license", "x" * 200_000 + " MIT license", "3-clause BSD license", "\ud800 mit license",
]


def test_base_places(spark):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS) if t is None or "\ud800" not in t] + [(None, TEXTS[0], "n"), (0, TEXTS[0], "n")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id if r.doc_id is not None else 0] or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        at = [(i, l) for p, l in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({l for _, l in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def _labels(text):
    return licenses.scan(text)[5]


def test_labels_of_the_method():
    assert _labels(TEXTS[0]) == "gpl,gpl-3" and _labels(TEXTS[1]) == "cc-by-nc-4.0" and _labels(TEXTS[6]) == "apache,apache-2.0"
    assert _labels(TEXTS[8]) == "lgpl-2.1" and _labels(TEXTS[11]) == "bsd-3-clause" and _labels(TEXTS[12]) == "mit"
    assert _labels("https://creativecommons.org/licenses/by-sa/4.0/") == "cc-by-sa-4.0" and _labels("plain words, all of them") == ""
    assert len(licenses.rules()) > 200


def test_suppression_keeps_the_widest_of_the_highest_priority():
    spans = licenses.detections("licensed under the mit license and the mit license")
    assert [(s, e, r.label) for s, e, r in spans][0] == (0, 30, "mit")
    assert sum(r.label == "mit" for *_, r in spans) == 2
    assert len(licenses.detections("mit license " * 3000)) == 3000


@pytest.mark.parametrize("scale", [1, 2**21])
def test_top_k_is_exact(spark, scale):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * scale
    base[40:80] = base[0]
    rows = [(int(i), [float(x) for x in v], "x") for i, v in enumerate(base)]
    rows += [(7, rows[9][1], "x"), (1000, None, "x"), (1001, [1.0, None], "x"), (1002, [math.nan] * 6, "x"), (1003, [math.inf] * 6, "x"), (None, rows[0][1], "x"), (1020, [1.0, 2.0], "x"), (1040, [], "x")]
    from pyspark.sql import functions as F

    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    v = e.where(F.col("vec_id").isNotNull() & nearest.usable(F.col("embedding"))).select("vec_id", nearest.floored(F.col("embedding"), 64).alias("v"))
    got = {}
    for r in nearest.nearest(v, v.where("vec_id % 20 = 0"), k=5, pivots=4, block=64, query_block=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for qi, q in [x for x in ints if x[0] % 20 == 0]:
        hits = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in ints if i != qi and len(x) == len(q))[:5]
        assert sorted(got.get(qi, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(hits)], qi


def test_no_vectors(spark):
    v = spark.createDataFrame([], "vec_id long, v array<long>")
    assert nearest.nearest(v, v).count() == 0


def test_no_block_is_sorted_whole(monkeypatch):
    """The k best of a block with many equal scores, repeated ids and more vectors than are evaluated at first."""
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (700, 3))
    ids = rng.integers(0, 500, 700)
    monkeypatch.setattr(np, "argsort", None)
    for i, at, score in nearest.best_in_block(ids[:20], x[:20], ids, x, x[-6:], 9, step=16):
        want = sorted((-int(x[j] @ x[i]), int(ids[j])) for j in range(len(x)) if ids[j] != ids[i])[:9]
        assert [(-int(s), int(ids[a])) for a, s in zip(at, score)] == want
