"""Language identification by nearest centroids.

A text is a vector of hashed letter n-grams (one to three letters, a run of other characters counts as one space), with
dampened counts weighted by inverse document frequency and scaled to length one. Each language has several centroids,
found by spherical k-means over its training texts; a text goes to the language of the centroid with the largest cosine.
A text farther from that centroid than nearly all training texts of the language is marked as rejected.

The centroids are fitted on a bounded sample of labelled rows: at most ``sample`` texts, the same number for each
language, drawn by a hash of their id and text. Document frequencies and the distances beyond which a text is rejected
come from all different training rows (id, text and language): tasks count, and the driver sees one vector of
``DIMENSIONS`` sums and one distance a learned language. Every text is read whole, in training as in prediction.

Defined cases: a null text, and one without any letter, is ``und`` with score 0. Without training rows all texts are.
Rows with a null language or id teach nothing; a null id is not held out. Ties go to the language that sorts first.
Repeated rows are predicted alike, and count once in training. Columns other than doc_id, text and lang are not read;
lang and doc_id are read for training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import sieve
from tracemill.llm.words import pieces

DIMENSIONS = 4096
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts of texts, and their numbers of letters."""
    flat, rows, letters = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        code = np.frombuffer((text if isinstance(text, str) else "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        letters[i] = letter.sum()
        if not letters[i]:
            continue
        c = np.where(letter, code, 32)
        c = np.r_[np.uint32(32), c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]], np.uint32(32)].astype(np.uint64)
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)
        for grams in (one, two * np.uint64(0xFF51AFD7ED558CCD), three * np.uint64(0xC4CEB9FE1A85EC53)):
            flat.append((grams >> np.uint64(52)).astype(np.int64) + i * DIMENSIONS)
    n = np.bincount(np.concatenate(flat), minlength=len(texts) * DIMENSIONS) if flat else np.zeros(len(texts) * DIMENSIONS)
    return n.reshape(len(texts), DIMENSIONS), letters


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n) * idf
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]  # of each centroid
    farthest: np.ndarray  # of each centroid: beyond this distance a text is rejected

    def predict(self, texts: list) -> list[tuple[str, float, bool]]:
        n, letters = counts(texts)
        if not self.langs:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        near = vectors(n, self.idf) @ self.centroids.T
        best = near.argmax(1)
        cos = np.clip(near[np.arange(len(texts)), best], 0.0, 1.0)
        return [
            (self.langs[b], float(c), bool(1 - c > self.farthest[b])) if k else (UNKNOWN, 0.0, True) for b, c, k in zip(best, cos, letters)
        ]


def _centroids(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the text farthest from those chosen so far."""
    chosen = [v.mean(0)]
    while len(chosen) < min(k, len(v)):
        chosen.append(v[(v @ np.array(chosen).T).max(1).argmin()])
    c = np.array(chosen)
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.array([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def fit(n: np.ndarray, langs: list[str], frequencies: np.ndarray, texts: int, centroids: int = 4, rounds: int = 10) -> Model:
    """Fits centroids to counts and languages of sampled texts; ``frequencies``: of the n-grams in all ``texts`` training texts."""
    if not len(n):
        return Model(np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), (), np.zeros(0))
    idf = np.log((1 + texts) / (1 + frequencies)) + 1
    v = vectors(n, idf)
    of = np.array(langs, dtype=object)
    found, names = [], []
    for lang in sorted(set(langs)):
        c = _centroids(v[of == lang], centroids, rounds)
        found.append(c)
        names += [lang] * len(c)
    return Model(idf, np.concatenate(found), tuple(names), np.full(len(names), 2.0))


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string")) % of


def taught(docs: DataFrame) -> DataFrame:
    """The different training rows: lang, text, u (a hash of id and text in [0, 1))."""
    u = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    known = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "lang", "text", u.alias("u"))
    return sieve.once(known, ["doc_id", "lang", "u"]).select("lang", "text", "u")


def sampled(known: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of ``known`` (of ``taught``), as many for each language."""
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(sample)
    each = max(1, sample // max(1, sizes.count()))
    # A hash threshold thins each language to about twice what is wanted before anything is sorted.
    thinned = known.join(sizes, "lang").where(F.col("u") * F.col("rows") < 2 * each + 50)
    return thinned.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("r") <= each).select("lang", "text", "u")


def document_frequencies(known: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts with a letter each n-gram is, and the number of those texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for b in pieces(batches, "text", 1_000_000):
            for at in range(0, len(b), 256):
                n, letters = counts(list(b["text"].iloc[at : at + 256]))
                total[:-1] += (n > 0).sum(0)
                total[-1] += (letters > 0).sum()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    got = known.select("text").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(DIMENSIONS + 1, np.int64)
    total[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return total[:-1], int(total[-1])


def farthest(known: DataFrame, model: Model, kept: float) -> dict[str, float]:
    """By learned language, the distance to the nearest own centroid within which the share ``kept`` of its texts lies."""
    own = {lang: np.flatnonzero([x == lang for x in model.langs]) for lang in set(model.langs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches, "text", 1_000_000):
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                n, letters = counts(list(part["text"]))
                near = vectors(n, model.idf) @ model.centroids.T
                rows = [(lang, 1 - float(x[own[lang]].max())) for lang, x, k in zip(part["lang"], near, letters) if k and lang in own]
                yield pd.DataFrame(rows, columns=["lang", "distance"])

    far = known.select("lang", "text").mapInPandas(run, "lang string, distance double").groupBy("lang").agg(F.percentile_approx("distance", kept).alias("far"))
    return {r["lang"]: r["far"] for r in far.collect()}


def trained(docs: DataFrame, sample: int = 1200, kept: float = 0.995, **how) -> Model:
    """Fits on the sample; its texts become counts in tasks, and the driver gets those."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, letters = counts(list(b["text"]))
            out = pd.DataFrame({"lang": b["lang"], "u": b["u"], "n": [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in n]})
            yield out[letters > 0]

    known = taught(docs)
    got = sampled(known, sample).mapInPandas(run, "lang string, u double, n binary").toPandas().sort_values(["lang", "u"])
    n = np.array([np.frombuffer(x, np.int32) for x in got["n"]]).reshape(len(got), DIMENSIONS)
    model = fit(n, list(got["lang"]), *document_frequencies(known), **how)
    far = farthest(known, model, kept) if model.langs else {}
    return replace(model, farthest=np.array([far.get(lang, 2.0) for lang in model.langs]))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine, 0 to 1), rejected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches, "text", 1_000_000):
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                out = pd.DataFrame(model.predict(list(part["text"])), columns=["lang_pred", "score", "rejected"])
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out_identified(docs: DataFrame, folds: int = 5, **how) -> DataFrame:
    """Learns from rows whose crc32(doc_id) leaves a remainder, predicts all: doc_id, held_out, lang_pred, score, rejected."""
    model = trained(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), folds) != 0), **how)
    held = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return identified(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
