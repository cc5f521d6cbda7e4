"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as connected classes.

The method is a count-vector R-tree. The distinct shingles of a document are hashed into groups, and the counts by group
are a point. The sum of the smaller of two points' coordinates bounds the overlap of the sets from above, and the sum of
their differences is at most the size of the symmetric difference. The tree has two layers.

* Cells. Documents are put in size classes. In a class no linked pair differs by more than D shingles, so if the groups
  are cut into D + 1 ranges or more, the points of a linked pair agree in all coordinates of at least one range. A
  document is filed under the coordinates of each of its ranges; only documents that share a cell can link. Some more
  ranges than D + 1 are made, so that agreement in ranges without any shingle does not count; a document with more empty
  ranges than that is also filed under the empty ones.
* A packed R-tree over folded points in each cell finds the pairs whose bound allows a link; these are verified on their
  whole sets.

A cell of copies is not searched for all pairs. Equal sets are one point. First each document is compared with one
other, of the least members of its cells the one it meets most often, and links make classes. Then only pairs of members of different classes are searched. Pairs
inside one class need no test: their class is known. So no link between classes is lost, and the classes are exact.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text with fewer words than a shingle is one
shingle; null or empty texts, or texts without words, have an empty set and are linked with nothing. Rows with a null
doc_id are linked with nothing and have a null class. Rows that share a doc_id count as one document: they are in one
class. Ties need no rule. Columns other than doc_id and text are not read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracemill.llm.components import components
from tracemill.llm.sieve import likely, marked
from tracemill.llm.words import distinct, hashed, mixed, shingles, spaced
from tracemill.session import drop_table, through_table

CLASS_RATIO = 1.25
FANOUT = 16
# Rows of results that a task's Python holds at a time, whatever the size of an Arrow batch or a cell.
HELD_ROWS = 1024
HELD_PAIRS = 20_000


def _sliced(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), HELD_ROWS):
            yield b.iloc[at : at + HELD_ROWS]


@cache
def class_starts() -> list[int]:
    """The least size of each size class."""
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO)))
    return out


def shingle_set(text, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return distinct(shingles(hashed(spaced(text)), k))


def cell_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The cells of a set, given as sorted hashes. The lowest bit says whether the cell is of the set's own size class.

    A set is also filed in larger classes that hold sets it may link to; there it matters only next to one of their own.
    """
    n, starts, out = len(s), class_starts(), []
    group = s >> np.uint64(32)
    sums = np.r_[np.uint64(0), np.cumsum(mixed(group + np.uint64(1)))]
    own = at = bisect_right(starts, n) - 1
    while n and percent * starts[at] <= 100 * n:
        most = starts[at + 1] - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        if differ:
            # Enough that few sets have more empty ranges than that: cells of empty ranges hold sets that share nothing.
            spare = 4 + differ // 16
            ranges = differ + 1 + spare
            edges = np.searchsorted((group * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1).astype(np.uint64))
            salt = mixed(np.arange(ranges).astype(np.uint64) + np.uint64((at + 1) << 40))
            key = mixed((sums[edges[1:]] - sums[edges[:-1]]) ^ salt)
            filled = edges[1:] > edges[:-1]
            key = (key & ~np.uint64(1)) | np.uint64(at == own)
            out.append(key[filled] if int((~filled).sum()) <= spare else key)
        at += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketched(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, a fingerprint of the set (f1, f2), and its cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _sliced(batches):
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                s = shingle_set(text, k)
                f1, f2 = s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64)
                rows.append((doc_id, len(s), f1.view(np.int64), f2.view(np.int64), cell_keys(s, percent).view(np.int64)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "f1", "f2", "cells"])
            out["doc_id"] = b["doc_id"].astype("Int64").to_numpy()
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, f1 long, f2 long, cells array<long>")


def _linked(k: int, percent: int):
    """Whether two texts link, as an Arrow function."""

    @pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, x = [], None, None
        for left, right in zip(a, b):
            if last is None or left != last:
                last, x = left, shingle_set(left, k)
            y = shingle_set(right, k)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return linked


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs a, b of doc_ids whose texts link. Texts of the many side are joined first, those of the few last."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = (
        likely(docs.select("doc_id", "text"), ids, ["doc_id"]).join(ids, "doc_id", "left_semi")
        .groupBy("doc_id", F.xxhash64("text").alias("same"))
        .agg(F.any_value("text").alias("text"))
    )
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.where(_linked(k, percent)(F.col("text_a"), F.col("text_b"))).select("a", "b").distinct()


def point_size(n: int) -> int:
    """Coordinates of the point of a set of n shingles: one for each or more, as a power of two."""
    return 1 << max(4, (n - 1).bit_length())


def points(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n and the point of each document, as counts of four bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _sliced(batches):
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                s = shingle_set(text, k)
                size = point_size(len(s))
                while True:
                    v = np.bincount((s >> np.uint64(65 - size.bit_length())).astype(np.int64), minlength=size)
                    if v.max() < 16:
                        break
                    size *= 2
                rows.append((doc_id, len(s), (v[::2] | (v[1::2] << 4)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "point"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, point binary")


def _unpacked(point: bytes, size: int) -> np.ndarray:
    """A point from its four-bit counts, with neighbouring coordinates added up to ``size`` of them."""
    half = np.frombuffer(point, np.uint8)
    return np.stack([half & 15, half >> 4], 1).reshape(size, -1).sum(1, dtype=np.uint16)


def folded(v: np.ndarray, size: int) -> np.ndarray:
    """Points with neighbouring coordinates added up to ``size`` of them."""
    return v.reshape(len(v), size, -1).sum(2, dtype=np.int64) if v.shape[1] > size else v.astype(np.int64)


def tree_pairs(
    n: np.ndarray, root: np.ndarray, points: np.ndarray, percent: int, other: np.ndarray | None = None, folds: int = 32
) -> Iterator[tuple[int, int, int]]:
    """Places and bounds of the pairs, of different roots, whose bound allows a link.

    The tree is built on points folded to few coordinates; what it lets through is tried on the unfolded points.
    The points are packed by size into leaves of ``FANOUT``, leaves into nodes, and a point goes down where the sum of
    the smaller of its coordinates and the node's largest ones still allows a link with the node's least size. With
    ``other``, a boolean side, only pairs across the sides are wanted.
    """
    order = np.lexsort((points[:, 0], n))
    n, root, points = n[order], root[order], points[order]
    v = folded(points, min(folds, points.shape[1]))
    side = None if other is None else other[order]
    # Levels from the leaves up: (largest coordinates, least size, largest size) of every FANOUT entries below.
    levels = [(v, n, n)]
    while len(levels[-1][0]) > 1 and (len(levels) == 1 or len(levels[-1][0]) > FANOUT):
        top, least, most = levels[-1]
        cut = np.arange(0, len(top), FANOUT)
        levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)))
    for i in range(len(n)):
        at = np.arange(len(levels[-1][0]))
        for depth in range(len(levels) - 1, -1, -1):
            top, least, most = levels[depth]
            bound = np.minimum(top[at], v[i]).sum(1)
            ok = (bound * (100 + percent) >= percent * (n[i] + least[at])) & (100 * most[at] >= percent * n[i])
            at = at[ok]
            if depth and len(at):
                below = len(levels[depth - 1][0])
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
            if not len(at):
                break
        else:
            at = at[(at > i) & (root[at] != root[i])]
            if side is not None:
                at = at[side[at] != side[i]]
            bound = np.minimum(points[at], points[i]).sum(1, dtype=np.int64)
            ok = bound * (100 + percent) >= percent * (n[i] + n[at])
            for j, most in zip(at[ok], bound[ok]):
                yield int(order[i]), int(order[j]), int(most)


def _cells(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells from batches that are sorted by cell."""
    held: list[pd.DataFrame] = []
    for b in batches:
        key = b["cell"].to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        for start, end in zip(starts, ends):
            part = b.iloc[start:end]
            if held and held[0]["cell"].iat[0] != part["cell"].iat[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def candidates(batches: Iterable[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """The pairs of cells that are sorted, in frames of bounded size: a, b, root_a, root_b, bound. A pair may come more than once."""
    columns = ["a", "b", "root_a", "root_b", "bound"]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for c in _cells(batches):
        size = 2 * min(map(len, c["point"]))
        v = np.array([_unpacked(p, size) for p in c["point"]])
        ids, root = c["doc_id"].to_numpy(np.int64), c["root"].to_numpy(np.int64)
        other = None if c["side_a"].iat[0] == c["side_b"].iat[0] else (c["side"] == c["side_b"]).to_numpy()
        for i, j, bound in tree_pairs(c["n"].to_numpy(np.int64), root, v, percent, other):
            i, j = (i, j) if ids[i] < ids[j] else (j, i)
            found[int(ids[i]), int(ids[j])] = (int(root[i]), int(root[j]), bound)
            if len(found) == HELD_PAIRS:
                yield pd.DataFrame([(*k, *x) for k, x in found.items()], columns=columns)
                found = {}
    if found:
        yield pd.DataFrame([(*k, *x) for k, x in found.items()], columns=columns)


def _searched(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs in cells. ``members``: cell, side_a, side_b (blocks of the cell), side, doc_id, root, n, point."""
    return members.mapInPandas(lambda batches: candidates(batches, percent), "a long, b long, root_a long, root_b long, bound long")


def _with_roots(df: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    named = roots.select(F.col("node").alias(node), "root")
    return df.join(named, node, "left").withColumn("root", F.coalesce("root", F.col(node)))


def open_cells(rooted: DataFrame) -> DataFrame:
    """The cells that hold several classes; of cells with the same members the least one, as it meets all their pairs.

    ``rooted``: cell, doc_id, root. Documents that are much alike share hundreds of cells, in which often no third one lies.
    """
    some = lambda *salt: F.sum(F.xxhash64("doc_id", *salt).cast("decimal(20,0)"))
    cells = rooted.groupBy("cell").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"), some().alias("m1"), some(F.lit(1)).alias("m2")
    )
    return cells.where("least <> most").groupBy("n", "m1", "m2").agg(F.min("cell").alias("cell")).select("cell")


def joined(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id of its class)."""
    texts = docs.select("doc_id", "text")
    with_cells = through_table(sketched(texts, k, percent))
    sketch = through_table(with_cells.drop("cells"))
    key = ["n_shingles", "f1", "f2"]
    there = "n_shingles > 0 and doc_id is not null"
    filled = sketch.where(there)
    # Only rows whose set may occur again are brought together; a set that occurs once is its own.
    told = marked(with_cells.where(there), filled.groupBy(*key).count().where("count > 1"), key)
    again = told.where("likely").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.any_value("cells").alias("cells"))
    sets = told.where("not likely").select(*key, "doc_id", "cells").unionByName(again)
    by_cell = Window.partitionBy("cell")
    filed = through_table(
        sets.select(F.explode("cells").alias("key"), "doc_id")
        .select(F.shiftright("key", 1).alias("cell"), F.col("key").bitwiseAND(F.lit(1)).alias("own"), "doc_id")
        .select(
            "cell", "doc_id", F.min("doc_id").over(by_cell).alias("leader"), F.count("*").over(by_cell).alias("members"),
            F.max("own").over(by_cell).alias("own"),
        )
        .where("members > 1 and own = 1").drop("own")
    )
    drop_table(with_cells)
    # Each member is tried against the leader that it shares most cells with; all other pairs are left to the search.
    shared = filed.where("doc_id <> leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("n"))
    stars = through_table(shared.groupBy("b").agg(F.max(F.struct("n", F.negative("a").alias("a"))).alias("most")).select((-F.col("most.a")).alias("a"), "b"))
    links = through_table(verified(stars, texts, k, percent))
    roots = through_table(components(links))

    # Cells that still hold several classes: all their pairs across classes, but those already tested.
    rooted = _with_roots(filed, roots, "doc_id")
    open_ = open_cells(rooted)
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    members = rooted.join(open_, "cell").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    spread = members.select(
        "cell", "doc_id", "root", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met")
    ).select(
        F.xxhash64("cell", F.least("side", "met"), F.greatest("side", "met")).alias("cell"), "doc_id", "root", "side",
        F.least("side", "met").alias("side_a"), F.greatest("side", "met").alias("side_b"),
    )
    spread = through_table(spread)
    drop_table(filed)
    wanted = spread.select("doc_id").distinct()
    # The join by doc_id after this leaves out what the sieve lets through by chance, so the texts themselves stay where they are.
    placed = points(likely(texts, wanted, ["doc_id"]), k)
    ready = spread.join(placed, "doc_id").repartition("cell").sortWithinPartitions("cell")
    pairs = through_table(_searched(ready, percent).join(stars, ["a", "b"], "left_anti").dropDuplicates(["a", "b"]))
    drop_table(spread)
    # The likeliest pair of two classes first: if it links, the others of the two need no test.
    likeliest = pairs.groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).agg(F.max(F.struct("bound", "a", "b")).alias("p"))
    first = through_table(likeliest.select("p.a", "p.b"))
    links = through_table(links.unionByName(verified(first, texts, k, percent)))
    roots = through_table(components(links))
    left = _with_roots(pairs.select("a", "b", "root_b"), roots, "a").withColumnRenamed("root", "now_a")
    left = _with_roots(left, roots, "b").where("root <> now_a").select("a", "b").join(first, ["a", "b"], "left_anti")
    more = verified(through_table(left), texts, k, percent)

    # From sets back to documents; rows that share an id are one document.
    known = filled.groupBy(*key).agg(F.min("doc_id").alias("node"))
    nodes = through_table(filled.select("doc_id", *key).join(known, key).select("doc_id", "n_shingles", "node"))
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("doc_id", "a")
    same = nodes.join(several, "doc_id").select("a", F.col("node").alias("b")).distinct()
    final = components(through_table(links.unionByName(more).unionByName(same)))
    rows = _with_roots(nodes, final, "node").select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    rest = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(rest)
