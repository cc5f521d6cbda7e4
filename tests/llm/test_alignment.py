"""Token alignment against whole texts encoded by the plain libraries and paired byte by byte."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import alignment as A
from tracemill.llm.queries import TOKENIZERS

A_FILE = Path(TOKENIZERS, "byte_bpe_50k.json").read_bytes()
B_FILE = Path(TOKENIZERS, "piece_bpe_32k.model").read_bytes()
TOKENS = A.Tokenizers(A_FILE, B_FILE)

TEXTS = [
    "Hello world, it's a test of the tokenizers.", None, "", " ", "  ", "a", " leading", "trailing ", "two  spaces   three", "tab\tand\nnew line\n\n", "foo\n bar \n\n baz  ",
    "café naïve 中文文字 \U0001f600\U0001f468‍\U0001f469  nbsp  x", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41> <pad>", "\x00\x01 nul\x00", "12345 678-90 3.14",
    "x" * 5000 + " " + "ab" * 3000, "word " * 400, "　wide   em", "don't we'll I'M 'S '", "\x1c \x1d\x85 y", "é combining ﬁ", "Hello world, it's a test of the tokenizers.", "\n", " \n ", "\r\n\r\n x",
]


def _plain(text):
    """Ends and ids of A and B of space + text by the plain libraries; None without tokens."""
    if not text:
        return None
    a = TOKENS.plain_a.encode(" " + text, add_special_tokens=False).ids
    b = TOKENS.b.encode(text)
    want = (" " + text).encode()
    if b"".join(TOKENS.a_bytes[i] for i in a) != want or b"".join(TOKENS.b_bytes[i] for i in b) != want:
        return None
    return a, b


def _ranges(ids, sizes):
    end, out = 0, []
    for i in ids:
        out.append((end, end + len(sizes[i])))
        end += len(sizes[i])
    return out


def _brute(texts):
    """The result columns by a walk over all tokens."""
    links, rows = Counter(), []
    for text in texts:
        got = _plain(text)
        if got is None:
            rows.append(None)
            continue
        a, b = got
        ra, rb = _ranges(a, TOKENS.a_bytes), _ranges(b, TOKENS.b_bytes)
        pairs, j = [], 0
        for i, (s, e) in enumerate(ra):
            while rb[j][1] <= s:
                j += 1
            k = j
            while k < len(rb) and rb[k][0] < e:
                pairs.append((a[i], b[k]))
                k += 1
        links.update(pairs)
        both = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, start = [], 0
        for cut in both:
            inside = [[t for t, (s, e) in zip(ids, r) if start <= s and e <= cut] for ids, r in ((a, ra), (b, rb))] if len(a) < 600 else None
            if inside is None:
                ia, ib = (np.searchsorted([s for s, _ in r], [start, cut]) for r in (ra, rb))
                inside = [a[ia[0] : ia[1]], b[ib[0] : ib[1]]]
            groups.append("|".join(",".join(map(str, x)) for x in inside))
            start = cut
        rows.append((len(a), len(b), len(both), pairs, ";".join(groups)))
    best = Counter()
    for (x, y), n in links.items():
        best[y] = max(best[y], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [
        zero if r is None else (r[0], r[1], r[2], len(r[3]), sum(links[p] == best[p[1]] for p in r[3]), sum(links[p] for p in r[3]), hashlib.sha256(r[4].encode()).hexdigest())
        for r in rows
    ]


def _got(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, chunk string, n_a int")
    out = A.aligned(df.repartition(3), A_FILE, B_FILE, **kw)
    assert out.dtypes[0] == ("doc_id", "bigint")
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(((r.doc_id, *(r[c] for c in cols)) for r in out.collect()), key=str)


@pytest.mark.parametrize("chunk", [50, 8_000_000])
def test_odd_texts(spark, chunk):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (0, TEXTS[0]), (2**60 + 1, "big id")]
    want = sorted(((i, *r) for (i, _), r in zip(rows, _brute([t for _, t in rows]))), key=str)
    assert _got(spark, rows, chunk=chunk) == want


def test_given_texts(spark):
    from conftest import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((i, *r) for (i, _), r in zip(rows, _brute([t for _, t in rows]))), key=str)
    assert _got(spark, rows, chunk=100_000) == want


def test_empty(spark):
    assert _got(spark, []) == [] and _got(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


ODD = st.text(alphabet=st.sampled_from(list(" \n\t\r  \x1c\x85ab'sST.,-10é中▁<>|_")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, st.text(max_size=60)))
def test_words_give_the_tokens_of_the_whole_text(text):
    got = _plain(text.encode("utf-8", "replace").decode())
    text = text.encode("utf-8", "replace").decode()
    words = A.words_of(text)
    assert "".join(" " + w for w in words) == " " + text
    if text and got is not None:
        parts = [TOKENS.tokens([w]) for w in words]
        assert None not in parts
        assert [i for p in parts for i in p[0]] == got[0] and [i for p in parts for i in p[1]] == got[1]
        found = A.Words(words, TOKENS)
        assert found.n_a.sum() == len(got[0]) and found.n_b.sum() == len(got[1])
    elif text and A.MARK not in text:
        assert any(TOKENS.tokens([w]) is None for w in words)


def test_ranks_give_the_tokens_of_the_merges():
    assert TOKENS.fast_a is not None and TOKENS.splits
    whole = [b.decode("utf-8") for b in TOKENS.a_bytes if b and not b.decode("utf-8", "ignore").encode() != b]
    for at in range(0, len(whole), 97):
        text = "".join(whole[at : at + 97])
        assert TOKENS.fast_a.encode_ordinary(text) == TOKENS.plain_a.encode(text, add_special_tokens=False).ids


def test_coalescing():
    a, b = np.array([2, 5, 6, 9]), np.array([1, 5, 9])
    ga, gb = A.coalesced(a, b)
    assert ga.tolist() == [0, 0, 1, 1] and gb.tolist() == [0, 0, 1]
    assert list(zip(*(x.tolist() for x in A.overlaps(a, b)))) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2)]
