"""CSV with line breaks inside quoted fields, read by several tasks a file.

Spark reads such files one task each, since a split cannot tell whether it starts inside a field. Quotes tell: a place is inside a quoted
field if an odd number of them come before it.

1. A scan counts, for each split, its quotes and what it would hold if it started outside or inside a field.
2. Running sums over the splits of a file (one small row each) say how each split starts and how many records come before it.
3. A second scan cuts each split into records from its first true record on. Pieces of records that cross splits, at most two a
   split, are put together by the split their record starts in. The fields are parsed by Spark.

The driver gets the hashes of the splits that start inside a field, 8 bytes for each such split, and a row per file; records never.

Quoting follows RFC 4180: a field that holds quotes, separators or line breaks is quoted, and quotes in it are doubled. Empty lines
between records are skipped, a carriage return before a record's last line feed and a byte order mark are dropped, and each file
starts with a header line, which may itself hold line breaks. A field that is never closed reaches to the end of its file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
SPLIT = ["_file", "_start"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, list[str]]]:
    """The lines of a task in order, cut where the split changes. A split may come in several runs."""
    for b in batches:
        if not len(b):
            continue
        files, starts = b["_file"].to_numpy(), b["_start"].to_numpy()
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        for x, y in zip(np.r_[0, cuts], np.r_[cuts, len(b)]):
            yield files[x], int(starts[x]), b["value"].iloc[x:y].tolist()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each run of a split: quotes, and by the parity of the quotes before a line: records that start there, whether any line does."""
    # A split's runs follow each other, so the parity goes on from run to run.
    at, quotes = None, 0
    for file, start, lines in _runs(batches):
        if at != (file, start):
            at, quotes = (file, start), 0
        before = quotes
        starts, cuts = [0, 0], [False, False]
        for line in lines:
            if line and line != "\r":
                starts[quotes & 1] += 1
            cuts[quotes & 1] = True
            quotes += line.count('"')
        yield pd.DataFrame(
            {"_file": [file], "_start": [start], "quotes": [quotes - before], "even": [starts[0]], "odd": [starts[1]], "cut_even": [cuts[0]], "cut_odd": [cuts[1]]}
        )


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: whether it starts inside a field, the records of its file before it, its own, and the split whose record it continues."""
    counted = lines.mapInPandas(
        _counted, "_file string, _start long, quotes long, even long, odd long, cut_even boolean, cut_odd boolean"
    ).groupBy(*SPLIT).agg(
        *[F.sum(c).alias(c) for c in ("quotes", "even", "odd")], *[F.max(c).alias(c) for c in ("cut_even", "cut_odd")]
    )
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    # A line starts a record if the quotes before it, those of earlier splits included, are even in number.
    inside = inside.withColumns({"own": F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")),
                                 "cut": F.when(F.col("inside"), F.col("cut_odd")).otherwise(F.col("cut_even"))})
    return inside.select(
        *SPLIT, "inside", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"),
        F.last(F.when(F.col("cut"), F.col("_start")), ignorenulls=True).over(before).alias("owner"),
    )


def _place(file: str, start: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{start} {file}".encode(), digest_size=8).digest(), "little")


WHOLE, TAIL, HEAD = 0, 1, 2


def _cut(inside: frozenset[int]):
    """Cuts splits into records; ``inside`` names those that start inside a field."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, open_, quoted, head = None, 0, None, False, False
        for file, start, lines in _runs(batches):
            out: list[tuple] = []
            if at != (file, start):
                if open_ is not None:
                    out.append((*at, HEAD if head else TAIL, n, "\n".join(open_)))
                at, n = (file, start), -1
                quoted = head = _place(file, start) in inside
                open_ = [] if head else None
            for line in lines:
                if open_ is None:
                    if not line or line == "\r":
                        continue
                    open_, n = [], n + 1
                open_.append(line)
                if line.count('"') & 1:
                    quoted = not quoted
                if not quoted:
                    out.append((*at, HEAD if head else WHOLE, n, "\n".join(open_)))
                    open_, head = None, False
            yield pd.DataFrame(out, columns=[*SPLIT, "kind", "n", "record"])
        if open_ is not None:
            yield pd.DataFrame([(*at, HEAD if head else TAIL, n, "\n".join(open_))], columns=[*SPLIT, "kind", "n", "record"])

    return run


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of ``schema`` by position, ``seq`` (from 0, by file name and line) and ``_file``."""
    lines = _lines(spark, path)
    splits = _splits(lines)
    inside = frozenset(_place(r["_file"], r["_start"]) for r in splits.where("inside").select(*SPLIT).toLocalIterator())
    cut = lines.mapInPandas(_cut(inside), "_file string, _start long, kind int, n long, record string")
    # The header is the first record of its file. The driver lists the files anyway, so it may number their rows.
    totals = splits.groupBy("_file").agg(F.greatest(F.sum("own") - 1, F.lit(0)).alias("rows")).collect()
    offsets, before = [], 0
    for r in sorted(totals, key=lambda r: r["_file"]):
        offsets.append((r["_file"], before))
        before += r["rows"]
    files = spark.createDataFrame(offsets, "_file string, of_files long")
    where = splits.join(files, "_file").select(*SPLIT, "owner", (F.col("of_files") + F.col("before") - 1).cast("long").alias("base"))
    whole = cut.where(F.col("kind") == WHOLE).select(*SPLIT, "n", "record")
    pieces = cut.where(F.col("kind") != WHOLE).join(where.select(*SPLIT, "owner"), SPLIT)
    owner = F.when(F.col("kind") == TAIL, F.col("_start")).otherwise(F.col("owner"))
    crossing = pieces.groupBy("_file", owner.alias("_at")).agg(
        F.max(F.when(F.col("kind") == TAIL, F.col("n"))).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_start", "record"))), lambda p: p["record"]), "\n").alias("record"),
    )
    records = whole.unionByName(crossing.select("_file", F.col("_at").alias("_start"), "n", "record"))
    data = records.where((F.col("_start") != 0) | (F.col("n") != 0)).join(where.select(*SPLIT, "base"), SPLIT)
    parsed = F.from_csv(F.regexp_replace("record", "\r$", ""), F.lit(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), OPTIONS)
    return data.select(parsed.alias("row"), (F.col("base") + F.col("n")).alias("seq"), "_file").select("row.*", "seq", "_file")
