"""Alignment of two tokenizers' tokens over whole texts, and how often tokens are linked across the corpus.

Each text is encoded by a byte-level BPE (A) and a sentencepiece BPE (B); tokens become ranges of the bytes of space + text. The method is
interval coalescing: all tokens of A and B are sorted by their start, the running maximum of their ends is accumulated, and a
group breaks where a start reaches that maximum. Inside groups, every pair of an A and a B token whose ranges overlap is a link.

A text is cut into words before each space that follows something other than white space. Neither tokenizer joins bytes
over such a cut: A's pattern has a space only at the start of a match or between other white space, and no piece of B has its space mark
after another character (which is looked up in the vocabulary; otherwise a text is one word). So the distinct words of a chunk of
documents are encoded and aligned once, and a document is a sequence of words.

1. A chunk is a run of whole documents of about ``chunk`` characters, or one longer document. It is written as one row per document (its
   figures and word numbers) and one row with the links of its words and the number of times it has each pair of ids.
2. Pair counts are summed over all chunks. Every chunk gets the counts of its own pairs back, and whether they are their B id's
   highest, by a join on the pair.
3. Each chunk's documents add up the figures of their words.

Shuffled are the distinct pairs of each chunk, and the word numbers of the documents once. Both vocabularies go to the tasks as bytes of the given
files, whose size is fixed. Nothing is collected.

Defined cases: texts that are null, empty, or whose joined A or B bytes differ from space + text (such as those holding U+2581, which B
reads as a space) have no tokens: zeros and an empty digest. Special tokens' strings are plain text. Very long words go to the plain
encoder of A's file, whose time does not grow with the square of the length. Rows that repeat an id or text, or have no id,
are documents like others and count as such. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.words import pieces
from tracemill.session import shared_dir

# The space mark of sentencepiece, and how byte-level vocabularies write bytes.
MARK = "▁"
LONG = 2_000
PIECE = 4_096
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


class Tokenizers:
    """Both tokenizers with the bytes of each of their tokens. ``a_file`` and ``b_file`` are the files' contents."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain_a = Tokenizer.from_str(a_file.decode("utf-8"))
        self.plain_a.encode_special_tokens = True
        model = json.loads(a_file)
        letters = byte_letters()
        special = {t["id"] for t in model.get("added_tokens", ()) if t.get("special")}
        vocabulary = {i: t for t, i in model["model"]["vocab"].items() if i not in special}
        self.a_bytes = [b""] * (max(vocabulary, default=-1) + 1)
        for i, t in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in t)
        # Merges in the order of the ids: ranks of whole tokens then say the same as the list of merges, and the faster encoder may be used.
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        first = len(vocabulary) - len(merges)
        ranked = all(model["model"]["vocab"].get(x + y) == first + n for n, (x, y) in enumerate(merges))
        byte_level = (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and (model["pre_tokenizer"]).get("use_regex", True)
        self.fast_a = None
        if ranked and byte_level and not model.get("normalizer"):
            ranks = {b: i for i, b in enumerate(self.a_bytes) if i in vocabulary}
            self.fast_a = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.space = self.b.piece_to_id(MARK)
        self.splits = byte_level and not any(MARK in p.lstrip(MARK) for p in names)
        self.a_size = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)

    def encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of A and B of ' ' + ' '.join(words). B has no way to begin with white space alone, hence the lone mark."""
        text = " ".join(words)
        if self.fast_a is not None and max(map(len, words)) <= LONG:
            a = self.fast_a.encode_ordinary(" " + text)
        else:
            a = self.plain_a.encode(" " + text, add_special_tokens=False).ids
        return a, self.b.encode(text) if text else [self.space]

    def tokens(self, words: list[str]) -> tuple[list[int], list[int]] | None:
        """As ``encode``; None if the joined bytes of either differ from the text."""
        a, b = self.encode(words)
        want = b" " + " ".join(words).encode("utf-8", "surrogatepass")
        same = b"".join([self.a_bytes[i] for i in a]) == want and b"".join([self.b_bytes[i] for i in b]) == want
        return (a, b) if same else None


# --- words of a text ---------------------------------------------------------------------

_UNEVEN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def words_of(text: str, splits: bool = True) -> list[str]:
    """The words of space + text, each without its first space."""
    if not splits:
        return [text]
    if text[:1] != " " and not _UNEVEN.search(text):
        return text.split(" ")
    return [w[1:] for w in _CUT.split(" " + text)]


def _uneven(word: str) -> bool:
    """Whether a word begins or ends with white space, so that it may join with a neighbour it does not have in its text."""
    return not word or word[0].isspace() or word[-1].isspace()


# --- alignment of the words of a chunk ---------------------------------------------------


def coalesced(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and every B token, from the ends of ranges that follow each other from 0."""
    start = np.concatenate([np.r_[0, a_end][:-1], np.r_[0, b_end][:-1]])
    end = np.concatenate([a_end, b_end])
    side = np.repeat([0, 1], [len(a_end), len(b_end)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.r_[False, start[order][1:] >= reach[:-1]][: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(a_end)], group[len(a_end) :]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of every overlapping pair, by A."""
    a_start, b_start = np.r_[0, a_end][:-1], np.r_[0, b_end][:-1]
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = high - low
    at = np.repeat(np.arange(len(a_end)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Words:
    """Tokens, groups and links of distinct words; a word without tokens is bad."""

    def __init__(self, words: list[str], t: Tokenizers):
        self.bad = np.zeros(len(words), bool)
        a_ids, b_ids, ends, of = [], [], [], []
        done, size = 0, [len(w.encode("utf-8", "surrogatepass")) + 1 for w in words]
        for run in self._runs(words, size):
            found = t.tokens([words[i] for i in run])
            # Where one word of a run has other bytes, each is asked alone.
            for part, got in [(run, found)] if found or len(run) == 1 else [([i], t.tokens([words[i]])) for i in run]:
                if got is None:
                    self.bad[part] = True
                    continue
                a_ids += got[0]
                b_ids += got[1]
                for i in part:
                    done += size[i]
                    ends.append(done)
                of += part
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        ends, of = np.array(ends, np.int64), np.array(of, np.int64)
        a_group, b_group = coalesced(a_end, b_end)
        at, bt = overlaps(a_end, b_end)
        n = len(words)
        # A word's tokens, groups and links are runs, as its end is the end of a token of both sides.
        cut = lambda x: np.r_[0, np.searchsorted(x, ends, "right")]
        a_cut, b_cut, link_cut = cut(a_end), cut(b_end), cut(a_end[at])
        last = np.unique(a_end[np.r_[a_group[1:] != a_group[:-1], True]]) if len(a) else a_end
        group_cut = cut(last)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        for out, c in ((self.n_a, a_cut), (self.n_b, b_cut), (self.n_groups, group_cut), (self.n_links, link_cut)):
            out[of] = np.diff(c)
        self.link_start = np.zeros(n, np.int64)
        self.link_start[of] = link_cut[:-1]
        self.pair = (a[at] << 32) | b[bt]
        self.link_word = np.repeat(of, np.diff(link_cut))
        self.text = [b""] * n
        for w, s in zip(of.tolist(), self._written(a, b, a_group, b_group, a_cut, b_cut)):
            self.text[w] = s

    @staticmethod
    def _runs(words: list[str], size: list[int]) -> Iterator[list[int]]:
        """Words that are encoded together: about ``PIECE`` bytes of plain ones, others alone."""
        run, total = [], 0
        for i, w in enumerate(words):
            if _uneven(w) or len(w) > LONG:
                yield [i]
                continue
            run.append(i)
            total += size[i]
            if total >= PIECE:
                yield run
                run, total = [], 0
        if run:
            yield run

    @staticmethod
    def _written(a, b, a_group, b_group, a_cut, b_cut) -> Iterator[bytes]:
        """The groups of each word as ``a1,a2|b1;``, each group ended by a semicolon."""
        a_last = np.r_[a_group[1:] != a_group[:-1], True][: len(a)]
        b_last = np.r_[b_group[1:] != b_group[:-1], True][: len(b)]
        group = np.concatenate([a_group, b_group])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))  # stable, so that tokens stay in their order
        name = [b"%d%c" % (i, c) for i, c in zip(a.tolist(), np.where(a_last, ord("|"), ord(",")).tolist())]
        name += [b"%d%c" % (i, c) for i, c in zip(b.tolist(), np.where(b_last, ord(";"), ord(",")).tolist())]
        name = [name[i] for i in order.tolist()]
        cuts = (a_cut + b_cut).tolist()
        for x, y in zip(cuts[:-1], cuts[1:]):
            yield b"".join(name[x:y])


# --- the corpus --------------------------------------------------------------------------

_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _chunk(ids: pd.Series, texts: list, t: Tokenizers) -> tuple[pd.DataFrame, dict]:
    """Rows of the documents of a chunk, and the links of its words."""
    flat, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if isinstance(text, str) and text and MARK not in text:
            w = words_of(text, t.splits)
            flat += w
            sizes[i] = len(w)
    coded = pa.array(flat, pa.large_string()).dictionary_encode()
    at, found = coded.indices.to_numpy(), Words(coded.dictionary.to_pylist(), t)
    ends = np.cumsum(sizes)
    total = lambda x: np.diff(np.r_[0, np.r_[0, np.cumsum(x[at])][ends]])
    good = (sizes > 0) & (total(found.bad.astype(np.int64)) == 0)
    out = {"doc_id": ids} | {c: np.where(good, total(getattr(found, c)), 0) for c in _FIGURES}
    digest, words = [], []
    for i, (start, end) in enumerate(zip(ends - sizes, ends)):
        if good[i]:
            digest.append(hashlib.sha256(b"".join([found.text[w] for w in at[start:end].tolist()])[:-1]).hexdigest())
            words.append(at[start:end].astype(np.int32).tobytes())
        else:
            digest.append("")
            words.append(None)
    often = np.bincount(at[np.repeat(good, sizes)], minlength=len(found.bad))
    pair, link = np.unique(found.pair, return_inverse=True)
    counts = np.bincount(link, weights=often[found.link_word], minlength=len(pair)).astype(np.int64)
    head = {
        "pairs": pair.tobytes(), "counts": counts.tobytes(), "links": link.astype(np.int32).tobytes(),
        "cuts": np.stack([found.link_start, found.n_links]).tobytes(),
    }
    return pd.DataFrame(out | {"groups_sha256": digest, "words": words}), head


_HEAD = ("pairs", "counts", "links", "cuts")


def _chunks(docs: DataFrame, a_file: bytes, b_file: bytes, chunk: int) -> DataFrame:
    """Writes documents and chunk rows (those with ``pairs``), and reads them back."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((a_file, b_file))
    schema = "chunk long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, " + ", ".join(
        f"{c} binary" for c in _HEAD
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, number = Tokenizers(*files.value), TaskContext.get().partitionId() << 32
        for b in pieces(batches, "text", chunk):
            rows, head = _chunk(b["doc_id"], b["text"].tolist(), t)
            yield rows.assign(chunk=number, **dict.fromkeys(_HEAD))
            yield pd.DataFrame([{"chunk": number, "doc_id": None, "groups_sha256": None, "words": None} | dict.fromkeys(_FIGURES, 0) | head])
            number += 1

    path = shared_dir(spark)
    # Ids travel as text, since numbers beside nulls would become floating-point ones.
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own.mapInPandas(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _pair_counts(heads: DataFrame) -> DataFrame:
    """chunk, at, pair, n: how often a chunk has each of its pairs; ``at`` is the pair's place in the chunk's list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, pairs, counts in zip(b["chunk"], b["pairs"], b["counts"]):
                pair = np.frombuffer(pairs, np.int64)
                yield pd.DataFrame({"chunk": c, "at": np.arange(len(pair), dtype=np.int32), "pair": pair, "n": np.frombuffer(counts, np.int64)})

    return heads.select("chunk", "pairs", "counts").mapInPandas(run, "chunk long, at int, pair long, n long")


def aligned(docs: DataFrame, a_file: bytes, b_file: bytes, chunk: int = 2_000_000) -> DataFrame:
    """``docs``: doc_id, text; the files' contents are those of a byte-level BPE (JSON) and a sentencepiece model.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    """
    written = _chunks(docs, a_file, b_file, chunk)
    own = _pair_counts(written.where("pairs is not null"))
    counts = own.groupBy("pair").agg(F.sum("n").alias("count"))
    # A B id has at most as many pairs as A has ids.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_b))
    stats = own.select("chunk", "at", "pair").join(counts, "pair").select(F.col("chunk").alias("of"), "at", "count", "best")
    kind = dict(docs.dtypes)["doc_id"]
    result = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def add(rows: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        is_head = rows["pairs"].notna()
        head, d = rows[is_head].iloc[0], rows[~is_head]
        link = np.frombuffer(head["links"], np.int32)
        start, size = np.frombuffer(head["cuts"], np.int64).reshape(2, -1)
        count, best = np.zeros(len(stats), np.int64), np.zeros(len(stats), np.int64)
        at = stats["at"].to_numpy(np.int64)
        count[at], best[at] = stats["count"].to_numpy(np.int64), stats["best"].to_numpy(np.int64)
        of_word = []
        for x in (count, best):
            before = np.r_[0, np.cumsum(x[link])]
            of_word.append(before[start + size] - before[start])
        sums = [[int(x[np.frombuffer(w, np.int32)].sum()) if w is not None else 0 for w in d["words"]] for x in of_word]
        return d.assign(count_sum=sums[0], n_best=sums[1])[["doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256"]]

    rows = written.select("chunk", "doc_id", *_FIGURES, "groups_sha256", "words", "pairs", "links", "cuts")
    out = rows.groupBy("chunk").cogroup(stats.groupBy("of")).applyInPandas(add, result)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
