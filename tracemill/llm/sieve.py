"""A sieve of fixed size on keys: which rows of a wide table may be wanted, without a shuffle of that table.

The keys are hashed to places of a bitmap of ``BUCKETS`` * 32,768 bits, so 8 MB are broadcast at most, however many keys
there are. A wanted row is always marked; another row is marked by chance, more often the fuller the bitmap is. So an
exact join has to follow, and a full bitmap costs speed but changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import through_table

BUCKETS = 2048
BITS = 15


def _place(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(BUCKETS << BITS))


def marked(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds ``likely``: whether the row's key may be among ``keys``. Null keys are keys like others."""
    place = _place(on)
    inside = lambda c: c.bitwiseAND(F.lit((1 << BITS) - 1))
    bits = keys.groupBy(F.shiftright(place, BITS).alias("bucket")).agg(F.bitmap_construct_agg(inside(place)).alias("bits"))
    at = inside(place)
    byte = F.conv(F.hex(F.substr("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    met = rows.withColumn("bucket", F.shiftright(place, BITS)).join(F.broadcast(bits), "bucket", "left")
    return met.withColumn("likely", hit).drop("bucket", "bits")


def likely(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key may be among ``keys``."""
    return marked(rows, keys, on).where("likely").drop("likely")


def once(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each key's row once. Rows of one key have to be equal; only those of repeated keys, and a few others, are shuffled."""
    repeated = through_table(rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").select(*on))
    seen = marked(rows, repeated, on)
    return seen.where(~F.col("likely")).drop("likely").unionByName(seen.where("likely").drop("likely").dropDuplicates(list(on)))
