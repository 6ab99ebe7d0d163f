"""Exact running sums inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 4096
KEY_BITS = 60


def hash_key(*parts: Column | str) -> Column:
    """A uniform 60-bit key from md5, the same in every SQL engine."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sums_before(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], value: str, out: str, rows: int) -> DataFrame:
    """Sum of `value` over the rows of the same group that come before, by (key, ties).

    `key` is a uniform 60-bit number. Rows are cut into ranges of it, about BUCKET_ROWS of `rows` each; range totals are
    summed in range order inside each group, and only the rows of one range and group are sorted together. A group that holds
    most rows has most ranges. Group columns must not be null.
    """
    bits = max(0, (max(1, rows) // BUCKET_ROWS).bit_length())
    cut = df.withColumn("__range", F.shiftright(key, KEY_BITS - bits).cast("int") if bits else F.lit(0))
    keys = [*group, "__range"]
    totals = cut.groupBy(*keys).agg(F.sum(value).alias("__total"))
    scope = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__total").over(scope), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(offsets, keys).withColumn(out, F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.drop("__offset", "__range")
