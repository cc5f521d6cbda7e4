"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

Documents are partitioned by the size of their shingle set into classes of powers of two. A class has a one-permutation
MinHash sketch of its own length: four bins for each shingle of its largest set, so that a short item that is contained
in a long document still has most of its minima to itself. Item and document are candidates if they agree in the
minimum of a bin at the document's sketch length. With four bins a shingle, a shared shingle is not a minimum with a
chance of about one in nine, so an item with at least ``least_sketch`` shingles that is contained to four fifths is
missed with a chance below one in a million; shorter items are searched by all of their shingles.

Only minima that are an item's too can agree, so documents are first read against a bitmap of the items' shingles, of
fixed size whatever the number of items. A document without a hit costs no more; the hits of others go to a join with
the items' shingles, which brings candidates and their exact containment at once: the words themselves are compared.

Defined cases: words are runs of letters, digits and characters beyond ASCII after lower-casing A-Z. An item or document
with fewer words than a shingle is one shingle of all its words. Null or empty texts, and rows with a null id, take no
part. Repeated rows count once; rows that share a doc_id but not a text are searched one by one, and the best containment
is given. Items that share an item_id likewise. Columns other than the id and the text are not read. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.words import alphanumeric, hashed, shingles
from tracemill.session import through_table

BINS_PER_SHINGLE = 4


def bins_of(size_class: int) -> int:
    return BINS_PER_SHINGLE << size_class


def size_class(n: int) -> int:
    """The least c with n <= 2^c."""
    return max(0, (n - 1).bit_length())


def minima(s: np.ndarray, size_class_: int) -> np.ndarray:
    """Of sorted distinct hashes, those that are the least of their bin at the sketch length of a class."""
    order = np.argsort(s & np.uint64(bins_of(size_class_) - 1), kind="stable")
    bins = (s & np.uint64(bins_of(size_class_) - 1))[order]
    return s[order[np.r_[True, bins[1:] != bins[:-1]]]] if len(s) else s


def levels(s: np.ndarray) -> np.ndarray:
    """For each of the sorted distinct hashes, the least class from which on it is a minimum; bins only get finer."""
    out = np.full(len(s), -1, np.int64)
    c = 0
    while (out < 0).any():
        out[(out < 0) & np.isin(s, minima(s, c))] = c
        c += 1
        if c > 60:  # equal low bits throughout: minimum of nothing finer
            out[out < 0] = 61
    return out


def _shingle_text(words: list[bytes], at: int, k: int) -> str:
    return b" ".join(words[at : at + k]).decode("utf-8", "replace")


def item_shingles(items: DataFrame, k: int, least_sketch: int) -> DataFrame:
    """item_id, item (one of its texts), n_item, shingle, h, level (from which class on it is searched by minima; -1: always)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item_id, item, text in zip(b["item_id"], b["item"], b["text"]):
                words = alphanumeric(text)
                h = shingles(hashed(words), k)
                s, first = np.unique(h, return_index=True)
                level = levels(s) if len(s) >= least_sketch else np.full(len(s), -1)
                rows += [(item_id, item, len(s), _shingle_text(words, int(f), k), x, int(n)) for x, f, n in zip(s.view(np.int64).tolist(), first, level)]
            yield pd.DataFrame(rows, columns=["item_id", "item", "n_item", "shingle", "h", "level"])

    known = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    return known.select("item_id", F.xxhash64("text").alias("item"), "text").mapInPandas(
        run, "item_id long, item long, n_item long, shingle string, h long, level int"
    )


def bitmap_of(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits places with the places of all ``h`` set. At most 2^bits / 64 rows reach the driver."""
    place = F.shiftrightunsigned("h", 64 - bits)
    words = (
        rows.select(F.shiftrightunsigned(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("m"))
        .groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    )
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return out


def hits(docs: DataFrame, bitmap: np.ndarray, bits: int, k: int) -> DataFrame:
    """Shingles of documents that may be an item's: doc_id, doc (its text), size_class, shingle, is_min."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                words = alphanumeric(text)
                h = shingles(hashed(words), k)
                place = (h >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero((bitmap[place >> 6] >> (place & 63)) & 1)
                if not len(at):
                    continue
                s = np.unique(h)
                c = size_class(len(s))
                found, first = np.unique(h[at], return_index=True)
                least = np.isin(found, minima(s, c))
                whole = int(np.bitwise_xor.reduce(s).view(np.int64))
                rows += [(doc_id, whole, c, _shingle_text(words, int(at[f]), k), bool(m)) for f, m in zip(first, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "doc", "size_class", "shingle", "is_min"])

    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return known.mapInPandas(run, "doc_id long, doc long, size_class int, shingle string, is_min boolean")


def contaminated(
    docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, least_sketch: int = 8, bits: int = 23
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_shared, n_item, containment."""
    wanted = through_table(item_shingles(items, k, least_sketch))
    seen = hits(docs, bitmap_of(wanted, bits), bits, k)
    met = seen.join(wanted.drop("h"), "shingle")
    candidate = (F.col("level") < 0) | (F.col("is_min") & (F.col("level") <= F.col("size_class")))
    pairs = (
        met.groupBy("doc_id", "doc", "item_id", "item")
        .agg(F.max("n_item").alias("n_item"), F.count_distinct("shingle").alias("n_shared"), F.bool_or(candidate).alias("candidate"))
        .where(F.col("candidate") & (100 * F.col("n_shared") >= percent * F.col("n_item")))
    )
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shared", "best.n_item", "best.containment")
