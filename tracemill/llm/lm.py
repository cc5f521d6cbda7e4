"""Language-model scoring with Elias-Fano tries of n-grams.

The model is a bigram model with Dirichlet smoothing over an add-one unigram model: p(w | v) = (c(vw) + m p(w)) /
(c(v) + m), p(w) = (c(w) + 1) / (N + V + 1). Its counts come from all training texts, and it is too large for one
machine, so that counts and questions meet in shards: a token goes, with the word before it, to the shard of its word.
A shard builds the trie of its training tokens and scores all of its tokens with it. One shuffle does it all: what goes
over it is packed by batches of texts and shards, and what comes back is one sum for each text and shard.

A trie is kept in files that are mapped into memory. Its first level is the sorted word hashes, its second the words that
stood before them, as one monotone sequence: the place of the word in the first level, then the hash of the word before.
Both levels and the pointers from one to the other are Elias-Fano coded, and the smoothed probabilities are quantised to
two bytes. A question finds its word in the first level, and there, in the range that the pointers give, the word before
by a successor search relative to it. The factor 1 / (c(v) + m) is charged where v itself is a token.

A word so frequent that it would fill a shard is spread over several by the word before it; its count is then taken from
the word counts, which are made first. Only such words, at most ``most_hot``, and a few totals reach the driver.

Defined cases: tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token; a null text is an empty
one and has the end token alone. Rows with a null id are scored but teach nothing and are not held out. Repeated rows
are counted and scored each. Without training rows all counts are 0. Words are told apart by 64-bit hashes, words before
by 40 bits. Columns other than doc_id and text are not read. Texts are read whole.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.words import hashed, mixed, spaced
from tracemill.session import through_table

END, START = np.uint64(0x0E4D_0E4D_0E4D_0E4D), np.uint64(0x57A2_7000_57A2_7000)
BEFORE_BITS = 40
CHUNK = 4096


class EliasFano:
    """A sorted sequence of 64-bit integers: low bytes as they are, high parts as a bit vector of unary gaps."""

    def __init__(self, values: np.ndarray, universe: int, path: str):
        self.n = len(values)
        bits = max(0, (universe // max(1, self.n)).bit_length() - 1)
        self.low_bytes = min(8, -(-bits // 8))
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(self.n, 8)
        high = self._high(values)
        ones = high.astype(np.int64) + np.arange(self.n)
        vector = np.zeros(int(ones[-1]) + 1 if self.n else 0, np.uint8)
        vector[ones] = 1
        self.skips = values[::CHUNK].copy()  # the first value of each chunk
        self.at = ones[::CHUNK].copy()  # and where its bit stands
        self.low = _mapped(raw[:, : self.low_bytes], path + ".low")
        self.bits = _mapped(np.packbits(vector, bitorder="little"), path + ".high")

    def _high(self, values: np.ndarray) -> np.ndarray:
        return values >> np.uint64(8 * self.low_bytes) if self.low_bytes < 8 else np.zeros(len(values), np.uint64)

    def chunk(self, c: int) -> np.ndarray:
        """The values of a chunk."""
        lo, hi = c * CHUNK, min(self.n, (c + 1) * CHUNK)
        first = int(self.at[c])
        last = int(self.at[c + 1]) if c + 1 < len(self.at) else 8 * len(self.bits)
        bits = np.unpackbits(np.asarray(self.bits[first // 8 : (last + 7) // 8]), bitorder="little")
        ones = np.flatnonzero(bits[first % 8 :])[: hi - lo] + first
        full = np.zeros((hi - lo, 8), np.uint8)
        full[:, : self.low_bytes] = self.low[lo:hi]
        low = full.view(np.uint64).ravel()
        if self.low_bytes == 8:
            return low
        return ((ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(8 * self.low_bytes)) | low

    def successors(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: the places of the first values not below them, and whether those are equal."""
        at, equal = np.full(len(keys), self.n, np.int64), np.zeros(len(keys), bool)
        of = np.searchsorted(self.skips, keys, side="right") - 1
        at[of < 0] = 0
        cuts = np.searchsorted(of, np.arange(len(self.skips) + 1))
        for c in range(len(self.skips)):
            lo, hi = int(cuts[c]), int(cuts[c + 1])
            if lo < hi:
                values = self.chunk(c)
                found = np.searchsorted(values, keys[lo:hi])
                at[lo:hi] = found + c * CHUNK
                inside = found < len(values)
                equal[lo:hi][inside] = values[found[inside]] == keys[lo:hi][inside]
        return at, equal

    def values(self, places: np.ndarray) -> np.ndarray:
        """The values at sorted places."""
        out = np.zeros(len(places), np.uint64)
        cuts = np.searchsorted(places, np.arange(len(self.skips) + 1) * CHUNK)
        for c in range(len(self.skips)):
            lo, hi = int(cuts[c]), int(cuts[c + 1])
            if lo < hi:
                out[lo:hi] = self.chunk(c)[places[lo:hi] - c * CHUNK]
        return out


def _mapped(a: np.ndarray, path: str) -> np.ndarray:
    """The array as a file mapped into memory."""
    if not a.size:
        return np.zeros(a.shape, a.dtype)
    np.ascontiguousarray(a).tofile(path)
    return np.memmap(path, a.dtype, "r", shape=a.shape)


def quantised(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Two-byte codes of values, with the least value and the step."""
    low = float(x.min()) if len(x) else 0.0
    step = (float(x.max()) - low) / 65535 if len(x) else 0.0
    return np.rint((x - low) / (step or 1.0)).astype(np.uint16), low, step


class Trie:
    """Words, the words before them, and smoothed numerators log10(c(vw) + m p(w)), in mapped files below ``folder``."""

    def __init__(self, word: np.ndarray, before: np.ndarray, count_of, total: int, distinct: int, m: float, folder: str):
        order = np.lexsort((before, word))
        word, before = word[order], before[order]
        new_word = np.r_[True, word[1:] != word[:-1]] if len(word) else np.zeros(0, bool)
        new = new_word | np.r_[True, before[1:] != before[:-1]] if len(word) else new_word
        words = word[new_word]
        place = np.cumsum(new_word) - 1
        pair_at = np.flatnonzero(new)
        c2 = np.diff(np.r_[pair_at, len(word)])
        c1 = np.diff(np.r_[np.flatnonzero(new_word), len(word)])
        c1 = count_of(words, c1)
        prior = m * (c1 + 1.0) / (total + distinct + 1)
        owner = place[pair_at]
        self.first = EliasFano(words, 1 << 64, os.path.join(folder, "words"))
        starts = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.uint64)
        self.pointers = EliasFano(starts, len(pair_at) + 1, os.path.join(folder, "pointers"))
        keys = (owner.astype(np.uint64) << np.uint64(BEFORE_BITS)) | before[pair_at]
        self.second = EliasFano(keys, max(1, len(words)) << BEFORE_BITS, os.path.join(folder, "before"))
        self.counts = _mapped(c1.astype(np.int64), os.path.join(folder, "counts"))
        self.unseen = self._codes(np.log10(prior), folder, "unseen")
        self.seen = self._codes(np.log10(c2 + prior[owner]), folder, "seen")
        self.new_word = float(np.log10(m / (total + distinct + 1)))

    @staticmethod
    def _codes(x: np.ndarray, folder: str, name: str) -> tuple[np.ndarray, float, float]:
        codes, low, step = quantised(x)
        return _mapped(codes, os.path.join(folder, name)), low, step

    def lookup(self, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For tokens sorted by word, then word before: counts of the words and numerators."""
        new = np.r_[True, word[1:] != word[:-1]] if len(word) else np.zeros(0, bool)
        at, known = self.first.successors(word[new])
        group = np.cumsum(new) - 1
        at, known = at[group], known[group]
        counts, out = np.zeros(len(word), np.int64), np.full(len(word), self.new_word)
        if known.any():
            places = at[known]
            counts[known] = self.counts[places]
            code, low, step = self.unseen
            value = low + step * code[places]
            # Relative to its word: inside the range of the pointers.
            begin, end = self.pointers.values(places), self.pointers.values(places + 1)
            found, equal = self.second.successors((places.astype(np.uint64) << np.uint64(BEFORE_BITS)) | before[known])
            equal &= (found >= begin.astype(np.int64)) & (found < end.astype(np.int64))
            code, low, step = self.seen
            value[equal] = low + step * code[found[equal]]
            out[known] = value
        return counts, out


def _token_batches(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list, list, list]]:
    """Texts in batches of about ``most`` tokens: rows (id, train), and hashes of their words."""
    ids, train, words, n = [], [], [], 0
    for b in batches:
        for doc_id, teaches, text in zip(b["doc_id"], b["train"], b["text"]):
            h = hashed(spaced(text))
            ids.append(doc_id)
            train.append(bool(teaches))
            words.append(h)
            n += len(h) + 1
            if n >= most or len(ids) >= 60_000:
                yield ids, train, words
                ids, train, words, n = [], [], [], 0
    if ids:
        yield ids, train, words


def word_counts(docs: DataFrame, batch_tokens: int) -> DataFrame:
    """h, n: how often each token occurs in training texts. ``docs``: doc_id, train, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, _, words in _token_batches(batches, batch_tokens):
            h, n = np.unique(np.concatenate(words), return_counts=True)
            yield pd.DataFrame({"h": np.r_[h, END].view(np.int64), "n": np.r_[n, len(ids)]})

    return docs.where("train").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


PACKED = "shard long, batch long, a binary, b binary, c binary, d binary, e binary"


def packed(docs: DataFrame, shards: int, hot: np.ndarray, parts: np.ndarray, batch_tokens: int) -> DataFrame:
    """Tokens by shard and batch: distinct words (a), their numbers (b), words before (c), texts (d), which teach (e).

    The first row of a batch, under a negative shard of its own, holds ids, token numbers and the texts that teach.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for number, (ids, train, words) in enumerate(_token_batches(batches, batch_tokens)):
            batch = (part << 32) + number
            size = np.array([len(h) + 1 for h in words])
            word = np.concatenate([x for h in words for x in (h, [END])]).astype(np.uint64)
            before = np.r_[START, word[:-1]]
            before[np.r_[0, np.cumsum(size)[:-1]]] = START
            doc = np.repeat(np.arange(len(ids)), size)
            known = np.array([i is not None and i == i for i in ids])
            number_of = np.array([int(i) if k else 0 for i, k in zip(ids, known)], np.int64)
            teach = np.packbits(np.array(train, bool)).tobytes()
            out = [(-1 - batch, batch, number_of.tobytes(), size.astype(np.int64).tobytes(), np.packbits(known).tobytes(), b"", teach)]
            sub = np.zeros(len(word), np.uint64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
                is_hot = hot[at] == word
                sub[is_hot] = mixed(before[is_hot]) % parts[at[is_hot]]
            shard = (mixed(word + sub * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)
            unique, inverse = np.unique(word, return_inverse=True)
            order = np.argsort(shard * len(unique) + inverse, kind="stable")
            shard, inverse, before, doc = shard[order], inverse[order], mixed(before[order]) >> np.uint64(64 - BEFORE_BITS), doc[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            five = before.view(np.uint8).reshape(-1, 8)[:, :5]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own = inverse[lo:hi]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                runs = np.diff(np.r_[first, hi - lo]).astype(np.uint32)
                out.append((
                    int(shard[lo]), batch, unique[own[first]].tobytes(), runs.tobytes(), np.ascontiguousarray(five[lo:hi]).tobytes(),
                    doc[lo:hi].astype(np.uint16).tobytes(), teach,
                ))
            yield pd.DataFrame(out, columns=["shard", "batch", "a", "b", "c", "d", "e"])

    return docs.mapInPandas(run, PACKED)


def _shard_scorer(hot: np.ndarray, hot_counts: np.ndarray, total: int, distinct: int, m: float):
    def count_of(words: np.ndarray, own: np.ndarray) -> np.ndarray:
        if not len(hot) or not len(words):
            return own
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        return np.where(hot[at] == words, hot_counts[at], own)

    def score(g: pd.DataFrame) -> pd.DataFrame:
        if g["shard"].iat[0] < 0:
            return g.drop(columns="shard")
        word = np.concatenate([np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)) for a, b in zip(g["a"], g["b"])])
        sizes = [len(d) // 2 for d in g["d"]]
        wide = np.zeros((len(word), 8), np.uint8)
        wide[:, :5] = np.concatenate([np.frombuffer(c, np.uint8).reshape(-1, 5) for c in g["c"]])
        before = wide.view(np.uint64).ravel()
        doc = np.concatenate([np.frombuffer(d, np.uint16) for d in g["d"]]).astype(np.int64)
        teach = np.concatenate([np.unpackbits(np.frombuffer(e, np.uint8))[np.frombuffer(d, np.uint16)] for d, e in zip(g["d"], g["e"])]).astype(bool)
        base = np.r_[0, np.cumsum([1 + int(np.frombuffer(d, np.uint16).max()) for d in g["d"]])]
        doc += np.repeat(base[:-1], sizes)
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(word[teach], before[teach], count_of, total, distinct, m, folder)
            order = np.lexsort((before, word))
            counts, value = trie.lookup(word[order], before[order])
        del trie
        value -= np.where(word[order] == END, 0.0, np.log10(counts + m))  # as the word before of the next token
        doc = doc[order]
        n = int(base[-1])
        sums = [np.bincount(doc, x, n) for x in (np.log10(counts + 1.0), counts > 0, value)]
        there = np.bincount(doc, minlength=n) > 0
        out = []
        for i, batch in enumerate(g["batch"]):
            lo, hi = int(base[i]), int(base[i + 1])
            at = np.flatnonzero(there[lo:hi])
            out.append((batch, at.astype(np.uint16).tobytes(), *(x[lo:hi][at].tobytes() for x in sums), b""))
        return pd.DataFrame(out, columns=["batch", "a", "b", "c", "d", "e"])

    return score


def scored(
    docs: DataFrame, train: Column, m: float = 50.0, shard_tokens: int = 1_500_000, batch_tokens: int = 1_000_000, most_hot: int = 65_536
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. ``train``: which rows teach."""
    texts = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), "text")
    counts = through_table(word_counts(texts, batch_tokens))
    end = int(END.view(np.int64))
    totals = counts.agg(F.sum("n"), F.count("*"), F.max(F.when(F.col("h") == end, F.col("n")))).first()
    total, distinct, teaching = int(totals[0] or 0), int(totals[1]), int(totals[2] or 0)
    shards = max(1, -(-total // shard_tokens))
    frequent = counts.where(F.col("n") > shard_tokens // 4).orderBy(F.desc("n"), "h").limit(most_hot).collect()
    frequent = sorted((int(np.int64(r["h"]).view(np.uint64)), r["n"]) for r in frequent)
    hot, hot_counts = np.array([h for h, _ in frequent], np.uint64), np.array([n for _, n in frequent], np.int64)
    parts = np.array([-(-4 * n // shard_tokens) for n in hot_counts], np.uint64)
    start = float(np.log10(teaching + m))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        head = g[g["e"].str.len() > 0].iloc[0]
        ids, size = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int64)
        known = np.unpackbits(np.frombuffer(head["c"], np.uint8))[: len(ids)].astype(bool)
        base, hits, score = np.zeros(len(ids)), np.zeros(len(ids)), np.full(len(ids), -start)
        for a, b, c, d, e in zip(g["a"], g["b"], g["c"], g["d"], g["e"]):
            if not len(e):
                at = np.frombuffer(a, np.uint16)
                base[at] += np.frombuffer(b)
                hits[at] += np.frombuffer(c)
                score[at] += np.frombuffer(d)
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64").copy() if known.all() else pd.array([int(i) if k else None for i, k in zip(ids, known)], "Int64"),
            "n_tokens": size, "n_known": np.rint(hits).astype(np.int64), "train_tokens": total,
            "base_score": base - size * np.log10(total + distinct + 1.0), "score": score,
        })

    sent = packed(texts, shards, hot, parts, batch_tokens)
    sums = sent.groupBy("shard").applyInPandas(
        _shard_scorer(hot, hot_counts, total, distinct, m), "batch long, a binary, b binary, c binary, d binary, e binary"
    )
    return sums.groupBy("batch").applyInPandas(
        merge, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def held_out_scored(docs: DataFrame, folds: int = 7, fold: int = 2, **how) -> DataFrame:
    """Learns from rows whose crc32(doc_id) leaves another remainder than ``fold``, scores all, and says which were held out."""
    of = F.crc32(F.col("doc_id").cast("string")) % folds
    out = scored(docs, of != fold, **how)
    return out.select("doc_id", F.coalesce(of == fold, F.lit(False)).alias("held_out"), *out.columns[1:])
