"""URL filters and mixing against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import mixing, urls
from tracemill.llm.queries import URL_RULES

CASES = [
    "https://X.Example.NET/en/5?x#y", "http://example.net", "http://example.com/de/", "http://a.example.com/dee/", "ftp://q.org/fr/://z",
    "HTTP://A.ORG/FR/x", "no scheme", "", None, "://", "http://?q", "http://Ä.net/#f", "http://notexample.net/en/1", "http://x.net/a\nb/c?d",
]


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    stop = next((i for i, c in enumerate(rest) if c in "?#" and i >= end), len(rest))
    return host, rest[end:stop]


def _rule(host, path):
    fits = [(len(t), t, v) for t, v in URL_RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(CASES)] + [(None, "http://x.net/", "y"), (0, CASES[0], "z")], "page_id long, url string, verdict string")
    got = urls.judged(pages, _labels(spark, []), URL_RULES).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        if r.page_id is not None:
            host, path = _parts(CASES[r.page_id])
            rule, verdict = _rule(host, path)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_mined_rules_match_a_count_by_hand(spark):
    rows, labels = [], []
    for i in range(400):
        bad_site = i % 4 == 0
        rows.append((i, f"http://{'win' if bad_site else 'calm'}.example.org/{'buy' if i % 2 else 'en'}/{i}"))
        if i < 300:
            labels.append((i, 0 if bad_site and i % 12 else 1, None if i % 5 else 0))
    labels += [(None, 0, 1), (3, 1, 0), (9999, 0, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = urls.mined_rules(pages, _labels(spark, labels)).collect()
    by = {frozenset(r.tokens): r for r in rules}
    assert frozenset(["label:win"]) in by and not any("label:calm" in k for k in by)
    one = by[frozenset(["label:win"])]
    assert one.confidence == pytest.approx(50 / 75) and one.support == pytest.approx(50 / 300)
    got = {r.page_id: r.verdict for r in urls.judged(pages, _labels(spark, labels), []).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i in range(400)}


def test_empty_pages(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string"), _labels(spark, [(1, 0, 0)]), URL_RULES).count() == 0


def test_targets_are_reshared_until_none_is_above():
    sized = [(100, 5.0), (1000, 2.0), (10, 1.0), (0, 5.0)]
    t = mixing.targets(sized, 3)
    assert sum(t) == pytest.approx(1110) and all(x <= 3 * s + 1e-9 for x, (s, _) in zip(t, sized))
    assert t[0] == 300 and t[2] == 30 and t[3] == 0 and t[1] == pytest.approx(780)
    assert mixing.targets([], 3) == [] and mixing.targets([(0, 1.0)], 3) == [0]


def test_quotas_are_exact():
    blocks = [17, 0, 5, 41]
    q = mixing.split_quotas(blocks, 6, 3)
    assert [sum(x) for x in q] == blocks
    per_shard = [sum(x[j] for x in q) for j in range(6)]
    assert max(per_shard) - min(per_shard) <= 2 and q == mixing.split_quotas(blocks, 6, 3)


def _docs(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = None if i % 50 == 0 else "big" if i % 3 else f"s{i % 7}"
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), source, 1))
    rows += [(5000, "a b\tc\x0bd e", "s1", 1)] * 300 + [(None, None, "s2", 1), (None, "", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long")


def test_mix_meets_targets_and_limits(spark):
    docs = _docs(spark)
    got = mixing.taken(docs, block_rows=16).collect()
    assert len(got) == docs.count()
    names = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r.size for r in got if r.source == s) for s in names}
    want = mixing.targets([(size[s], float((5, 2, 1)[i % 3])) for i, s in enumerate(names)], 3)
    for s, t in zip(names, want):
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and r.target == pytest.approx(t) for r in mine)
        assert abs(sum(r.taken for r in mine) - t) <= 100.5
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) and len(r.shards) * r.size == r.taken for r in got)
    assert {r.size for r in got if r.doc_id == 5000} == {4}


def test_mix_is_the_same_for_any_partitioning(spark):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(mixing.taken(_docs(spark).repartition(3))) == key(mixing.taken(_docs(spark).repartition(11, "doc_id")))


def test_mixed_rows_and_empty(spark):
    docs = _docs(spark)
    rows = mixing.mixed_rows(docs, block_rows=16, shards=4)
    total = mixing.taken(docs, block_rows=16, shards=4).agg(F.sum("taken")).first()[0]
    assert rows.agg(F.sum("size")).first()[0] == total and {r.shard for r in rows.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert mixing.taken(docs.limit(0)).count() == 0
