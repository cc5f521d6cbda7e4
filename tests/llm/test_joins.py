"""The n-gram join and decontamination against plain Python."""

import random
import re

import numpy as np
import pytest

from tracemill.llm import components, contamination, ngram_join


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _classes(rows, k, percent):
    """Least reachable doc_id by id, from all pairs."""
    sets = [(i, _shingles(re.findall(r"[^\x20\x09-\x0D]+", _lower(t)), k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def _near_copies(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    rows, i = [], 0
    for length in (2, 4, 5, 7, 9, 12, 20, 40, 150, 400):
        for _ in range(3):
            base = [word() for _ in range(length)]
            for edits in (0, 0, 1, 1, 2, 3, length // 30, length // 20, length // 12):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = word()
                rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
                i += 1
            for _ in range(3):  # chains: each a little further from the base
                w = list(w)
                w[rng.randrange(len(w))] = word()
                rows.append((i, " ".join(w)))
                i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_classes_match_all_pairs(spark, k, percent):
    rows = _near_copies() + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "One"), (None, "one"), (9005, "a b c"), (9006, "Ä ä")]
    rows += [(9003, "one"), (9010, "w " * 20000), (9011, "w " * 30000), (9012, "first text of an id used twice"), (9012, "quite another text of it")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
    got = ngram_join.joined(df, k, percent).collect()
    want = _classes(rows, k, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]), r
    sizes = {(i, len(_shingles(re.findall(r"[^\x20\x09-\x0D]+", _lower(t)), k))) for i, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def test_cells_in_blocks_lose_nothing(spark):
    rows = [(i, t) for i, t in _near_copies(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.joined(df, 4, 85, block=3).collect()}
    assert got == _classes(rows, 4, 85)


def test_empty_table(spark):
    assert ngram_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _share_a_cell(a, b):
    x, y = ngram_join.cell_keys(a, 85), ngram_join.cell_keys(b, 85)
    one = np.uint64(1)
    cells = np.intersect1d(x >> one, y >> one)
    return any(((z & one) == 1)[np.isin(z >> one, cells)].any() for z in (x, y))


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(2)
    for n in list(range(6, 40)) + [90, 333, 1000, 5000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, n // 6) + 1)
            b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**64, rng.integers(0, max(1, n // 6) + 1), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert _share_a_cell(a, b)


def test_tree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(3)
    v = rng.poisson(3, (400, 8)).astype(np.int64)
    n, root = v.sum(1), rng.integers(0, 50, 400)
    got = {tuple(sorted(p[:2])) for p in ngram_join.tree_pairs(n, root, v, 85, folds=4)}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if root[i] != root[j] and np.minimum(v[i], v[j]).sum() * 185 >= 85 * (n[i] + n[j])}
    assert got == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (130, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 131)}


ITEM = [f"word{i}" for i in range(40)]


def test_items_in_documents(spark):
    rng = random.Random(9)
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    items = [(1, " ".join(ITEM)), (2, "short item of five words"), (3, "tiny"), (4, ""), (5, None), (None, "short item of five words"), (1, " ".join(ITEM)), (6, "a b c d e f g")]
    docs = [
        (1, " ".join(noise(5000) + ITEM + noise(4000))), (2, " ".join(ITEM[:37]).upper() + "!"), (3, " ".join(ITEM[:20])), (4, None), (5, ""),
        (6, "x short, item of FIVE words y"), (7, "tiny"), (8, "tiny bit"), (None, " ".join(ITEM)), (1, "other text"), (9, " ".join(noise(30) + ITEM[:20] + noise(3) + ITEM[20:])),
        (10, "zz a b c d e f g zz " * 2000),
    ] + [(20 + i, " ".join(noise(rng.randrange(2000)) + ITEM)) for i in range(60)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_item int")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in contamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    want = {}
    for i, t in docs:
        for j, x in items:
            if None not in (i, j, t, x):
                a, b = _shingles(words(t), 5), _shingles(words(x), 5)
                if b and 100 * len(a & b) >= 80 * len(b):
                    want[i, j] = (len(a & b), len(b))
    assert got == want and (1, 1) in want and (6, 2) in want and (7, 3) in want and (8, 3) not in want


def test_a_full_bitmap_only_costs_time(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p {i}") for i in range(5)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c d e f g h i j k l m n o")], "item_id long, text string")
    assert contamination.contaminated(docs, items, bits=6).count() == 5


def test_no_items_or_documents(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination.contaminated(docs, items).count() == 0


def test_sieve_marks_every_wanted_row(spark):
    from tracemill.llm.sieve import likely, marked

    rows = spark.range(-500, 500).selectExpr("id as doc_id", "'t' as text").unionByName(spark.sql("select cast(null as long) doc_id, 't' text"))
    keys = spark.range(-500, 500, 7).selectExpr("id as doc_id")
    got = {r["doc_id"] for r in likely(rows, keys, ["doc_id"]).collect()}
    assert set(range(-500, 500, 7)) <= got and len(got) < 200
    assert marked(rows, keys, ["doc_id"]).count() == 1001
    assert likely(rows, keys.where("false"), ["doc_id"]).count() == 0


def test_python_holds_few_rows_of_a_batch_or_cell(monkeypatch):
    """Results leave in frames of bounded size, also from one cell with many pairs of different classes."""
    import pandas as pd

    from tracemill.llm import ngram_join as G

    n = 60
    cell = pd.DataFrame({"cell": 1, "side_a": 0, "side_b": 0, "side": 0, "doc_id": range(n), "root": range(n), "n": 16, "point": [bytes([0x11] * 8)] * n})
    monkeypatch.setattr(G, "HELD_PAIRS", 100)
    frames = list(G.candidates([cell], 80))
    pairs = [p for f in frames for p in zip(f["a"], f["b"])]
    assert max(map(len, frames)) == 100 and len(pairs) == len(set(pairs)) == n * (n - 1) // 2
    monkeypatch.setattr(G, "HELD_ROWS", 7)
    assert [len(f) for f in G._sliced([cell])] == [7] * 8 + [4]


def test_sets_that_share_nothing_share_few_cells():
    """Empty ranges are alike in all sets, so they make cells only where a set has many of them."""
    rng = np.random.default_rng(5)
    seen = {}
    for i in range(600):
        s = np.unique(rng.integers(0, 2**64, 180 + i % 40, dtype=np.uint64))
        for c in ngram_join.cell_keys(s, 80) >> np.uint64(1):
            seen.setdefault(int(c), []).append(i)
    assert sum(len(x) for x in seen.values() if len(x) > 1) < 600


def test_cells_with_the_same_members_are_searched_once(spark):
    cells = {1: [(10, 10), (11, 11)], 2: [(10, 10), (11, 11)], 3: [(10, 10), (11, 11), (12, 11)], 4: [(11, 11), (12, 11)], 5: [(10, 10), (10, 10), (11, 11)]}
    rows = [(c, d, r) for c, of in cells.items() for d, r in of]
    found = ngram_join.open_cells(spark.createDataFrame(rows, "cell long, doc_id long, root long"))
    assert sorted(r.cell for r in found.collect()) == [1, 3, 5]
