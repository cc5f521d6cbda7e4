"""Row numbers and running sums over groups of any size.

A plain window hands each group to one task. These cut a group into ranges of
its position, work inside the ranges, and add offsets that come from one small
row per range; the offsets are summed up the same way one level higher. With
ranges of 100,000 no window sees more than 100,000 rows for positions up to 10^15.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 100_000


def _before(value: str, keys: Sequence[str], order: Sequence[str], inclusive: bool = False) -> Column:
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0))


def _with_offset(df: DataFrame, keys: Sequence[str], part: str, value: str, width: int, levels: int) -> DataFrame:
    """Adds ``_offset``, the sum of ``value`` over all lower ``part`` numbers of the group."""
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    if levels > 1:
        wider = f"_part{levels}"
        upper = sums.withColumn(wider, F.floor(F.col(part) / width))
        upper = _with_offset(upper, keys, wider, "_sum", width, levels - 1)
        before = F.col("_offset") + _before("_sum", [*keys, wider], [part])
        offsets = upper.withColumn("_offset", before)
    else:
        offsets = sums.withColumn("_offset", _before("_sum", keys, [part]))
    names = [*keys, part]
    offsets = offsets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "_offset")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)]
    return df.join(offsets, on).drop(*[f"_k{i}" for i in range(len(names))])


def running_sum(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str,
    ties: Sequence[str] = (), inclusive: bool = False, width: int = WIDTH, levels: int = 2,
) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, by a whole-number ``position``."""
    cut = df.withColumns({"_part": F.floor(F.col(position) / width), "_value": value.cast("double")})
    cut = _with_offset(cut, keys, "_part", "_value", width, levels)
    total = F.col("_offset") + _before("_value", [*keys, "_part"], [position, *ties], inclusive)
    return cut.withColumn(name, total).drop("_part", "_value", "_offset")


def row_numbers(
    df: DataFrame, keys: Sequence[str], position: str, name: str, width: int = WIDTH, levels: int = 2
) -> DataFrame:
    """1, 2, .. within each group by position."""
    out = running_sum(df, keys, position, F.lit(1), name, inclusive=True, width=width, levels=levels)
    return out.withColumn(name, F.col(name).cast("long"))


def salted_lookup(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, salts: int = 16
) -> DataFrame:
    """Left join to a unique-keyed table that is far smaller, hot keys cut into ``salts`` parts."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")
