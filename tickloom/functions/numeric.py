"""Small numeric column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Floor under prices, volatilities and similar divisors (fixed value).
PRICE_FLOOR = 1e-6
# Standard deviations at or below this count as zero in moment features (fixed value).
FLAT_STD = 1e-12


def double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def floored(c: Column, low: float = PRICE_FLOOR) -> Column:
    """`c` clipped from below, null staying null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clipped(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a/b, null where b is zero (also in ANSI mode)."""
    return F.try_divide(a, b)


def ratio_or(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(ratio(a, b), F.lit(default))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (null counts as not holding)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.sum(flag(condition))


def moments_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are present, as an aggregate.

    Null, not an error, when a side does not vary.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def fill_by_type(df: DataFrame) -> DataFrame:
    """Nulls to 0 in numeric columns and to '' in strings."""
    return df.na.fill(0.0).na.fill(0).na.fill("")
