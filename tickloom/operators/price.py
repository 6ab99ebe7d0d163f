"""Per-session price features: OHLC statistics, technical indicators and the older block.

Bars carry a position `bar_ix` inside a session of at most a hundred bars, so a window over one
session stays small however skewed the ticks behind the bars are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from tickloom.functions.numeric import FLAT_STD, double, floored, moments_corr, ratio, ratio_or

# Output column names.
PRICE_COLUMNS = [
    "seen_return_open_to_close",
    "seen_return_close_to_close",
    "seen_high_return",
    "seen_low_return",
    "tail_return_5",
    "tail_return_10",
    "close_mean",
    "close_std",
    "close_volatility",
    "realized_volatility",
    "intrabar_range_mean",
    "up_bar_ratio",
    "positive_close_change_ratio",
    "max_drawdown",
    "trend_slope",
    "trend_slope_normalized",
]

# Output column names.
TECHNICAL_COLUMNS = [
    "ret_last_5",
    "ret_last_10",
    "ret_last_20",
    "ema_10_30_cross",
    "price_vs_ema10",
    "rsi_14",
    "ret_skew",
    "ret_kurt",
    "autocorr_1",
    "autocorr_5",
    "fourier_max_freq_amp",
    "fourier_2nd_freq_amp",
    "green_bar_ratio",
    "avg_bar_spread",
]

# Output column names.
LEGACY_COLUMNS = [
    "seen_return",
    "log_return",
    "seen_volatility",
    "max_high_ratio",
    "min_low_ratio",
    "high_low_spread",
    *TECHNICAL_COLUMNS,
]

RSI_WINDOW = 14


def _session() -> WindowSpec:
    return Window.partitionBy("session")


def _by_bar() -> WindowSpec:
    return _session().orderBy("bar_ix")


def _numbered(bars: DataFrame) -> DataFrame:
    """Bars as doubles with position i = 0..n-1, previous close, change and clipped return."""
    prices = bars.where(F.col("session").isNotNull()).select(
        "session", double("bar_ix").alias("bar_ix"), *[double(c).alias(c) for c in ("open", "high", "low", "close")]
    )
    placed = prices.withColumns(
        {
            "i": F.row_number().over(_by_bar()) - 1,
            "n": F.count(F.lit(1)).over(_session()),
            "prev": F.lag("close").over(_by_bar()),
        }
    )
    change = F.col("close") - F.col("prev")
    return placed.withColumn("change", change).withColumn("ret", ratio(change, floored(F.col("prev"))))


def _first(c: str) -> Column:
    return F.min_by(c, "i")


def _last(c: str) -> Column:
    return F.max_by(c, "i")


def _tail(k: int) -> Column:
    then = F.max(F.when(F.col("i") == F.col("n") - 1 - k, F.col("close")))
    return ratio_or(_last("close"), then, 1.0) - 1.0


def price_block(bars: DataFrame) -> DataFrame:
    """The sixteen OHLC statistics, one row per session."""
    running = F.max("close").over(_by_bar().rowsBetween(Window.unboundedPreceding, 0))
    rows = _numbered(bars).withColumn("drawdown", ratio(F.col("close"), floored(running)) - 1.0)
    o, h, lo, c, ret = (F.col(x) for x in ("open", "high", "low", "close", "ret"))
    features = rows.groupBy("session").agg(
        (ratio(_last("close"), _first("open")) - 1.0).alias("seen_return_open_to_close"),
        (ratio(_last("close"), _first("close")) - 1.0).alias("seen_return_close_to_close"),
        (ratio(F.max(h), _first("open")) - 1.0).alias("seen_high_return"),
        (ratio(F.min(lo), _first("open")) - 1.0).alias("seen_low_return"),
        _tail(5).alias("tail_return_5"),
        _tail(10).alias("tail_return_10"),
        F.avg(c).alias("close_mean"),
        F.stddev_pop(c).alias("close_std"),
        F.stddev_pop(ret).alias("close_volatility"),
        F.sqrt(F.avg(ret * ret)).alias("realized_volatility"),
        F.avg((h - lo) / floored(o)).alias("intrabar_range_mean"),
        F.avg((c >= o).cast("double")).alias("up_bar_ratio"),
        F.avg((F.col("change") >= 0).cast("double")).alias("positive_close_change_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.regr_slope(c, F.col("bar_ix")).alias("trend_slope"),
    )
    slope = F.col("trend_slope") / floored(F.col("close_mean"))
    return features.withColumn("trend_slope_normalized", slope).na.fill(0.0).select("session", *PRICE_COLUMNS)


def _ema_last(span: int) -> Column:
    """Adjusted exponential mean at the last bar: a weighted mean with weights (1-a)^(bars to the end)."""
    keep = 1.0 - 2.0 / (span + 1.0)
    weight = F.pow(F.lit(keep), F.col("n") - 1 - F.col("i"))
    return F.sum(F.col("close") * weight) / F.sum(weight)


def _rsi_leg(leg: Column) -> Column:
    """Wilder average of one leg at the last bar, in closed form.

    The seed sums the first 15 changes but divides by 14, and the recurrence starts on the 15th
    change again; both are kept. `i` is the bar a change ends on.
    """
    w = RSI_WINDOW
    decay = F.lit((w - 1.0) / w)
    seed = F.sum(F.when(F.col("i") <= w + 1, leg)) / w
    steps = F.max(F.col("n")) - w - 1
    later = F.sum(F.when(F.col("i") >= w + 1, leg * F.pow(decay, F.col("n") - 1 - F.col("i")))) / w
    return seed * F.pow(decay, steps) + later


_AMPLITUDES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("fourier_max_freq_amp", "fourier_2nd_freq_amp")])


def two_largest_amplitudes(closes: pa.Array) -> pa.Array:
    """The two largest Fourier amplitudes of each list's mean-removed closes, nulls as the mean; null below four bars.

    All lists of one length are transformed together, bar after bar: sums in bar order come out the same in any engine to the last digits.
    """
    offsets = np.asarray(closes.offsets)
    values = closes.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    best = np.full((len(closes), 2), np.nan)
    for n in np.unique(sizes[sizes >= 4]):
        rows = np.flatnonzero(sizes == n)
        x = values[starts[rows, None] + np.arange(n)]
        known = ~np.isnan(x)
        rows, x, known = (a[known.any(axis=1)] for a in (rows, x, known))
        mean = np.cumsum(np.where(known, x, 0.0), axis=1)[:, -1] / known.sum(axis=1)
        x = np.where(known, x - mean[:, None], 0.0)
        k = np.arange(1, n // 2 + 1)
        even, odd = np.zeros((len(x), len(k))), np.zeros((len(x), len(k)))
        for i in range(n):
            angle = 2 * np.pi * k * i / n
            even += x[:, i, None] * np.cos(angle)
            odd += x[:, i, None] * np.sin(angle)
        best[rows] = np.sort(np.sqrt(even**2 + odd**2), axis=1)[:, :-3:-1]
    fields = [pa.array(best[:, i], mask=np.isnan(best[:, i])) for i in (0, 1)]
    return pa.StructArray.from_arrays(fields, names=[f.name for f in _AMPLITUDES])


def _technical(rows: DataFrame, ret: Column) -> DataFrame:
    """Unguarded technical columns from numbered bars; `ret` is the bar return to use."""
    rows = rows.withColumn("r", ret)
    rows = rows.withColumns({f"lead_{k}": F.lead("r", k).over(_by_bar()) for k in (1, 5)})
    r, o, h, lo, c = (F.col(x) for x in ("r", "open", "high", "low", "close"))
    change = F.col("change")
    up, down = F.when(change >= 0, change).otherwise(0.0), F.when(change < 0, -change).otherwise(0.0)

    def lag_std(k: int, side: Column) -> Column:
        pair = r.isNotNull() & F.col(f"lead_{k}").isNotNull()
        return F.stddev_pop(F.when(pair, side))

    agg = rows.groupBy("session").agg(
        F.max("n").alias("n"),
        F.count(r).alias("n_ret"),
        _last("close").alias("last"),
        _tail(5).alias("ret_last_5"),
        _tail(10).alias("ret_last_10"),
        _tail(20).alias("ret_last_20"),
        _ema_last(10).alias("ema10"),
        _ema_last(30).alias("ema30"),
        _rsi_leg(up).alias("up"),
        _rsi_leg(down).alias("down"),
        F.stddev_pop(r).alias("ret_std"),
        F.skewness(r).alias("skew"),
        F.kurtosis(r).alias("kurt"),
        *[moments_corr(r, F.col(f"lead_{k}")).alias(f"corr_{k}") for k in (1, 5)],
        *[
            F.least(lag_std(k, r), lag_std(k, F.col(f"lead_{k}"))).alias(f"std_{k}")
            for k in (1, 5)
        ],
        F.avg((c > o).cast("double")).alias("green_bar_ratio"),
        F.avg((h - lo) / floored(o)).alias("avg_bar_spread"),
        F.avg(ratio(h - lo, o)).alias("raw_bar_spread"),
        F.transform(F.sort_array(F.collect_list(F.struct("i", "close"))), lambda s: s["close"]).alias("closes"),
    )
    amplitudes = F.arrow_udf(two_largest_amplitudes, _AMPLITUDES)
    return agg.withColumn("two", amplitudes("closes")).select(*[x for x in agg.columns if x != "closes"], "two.*")


def _rsi() -> Column:
    rs = ratio(F.col("up"), F.col("down"))
    return F.when(F.col("down") == 0, F.lit(100.0)).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs))


def technical_block(bars: DataFrame) -> DataFrame:
    """The fourteen technical indicators, one row per session."""
    t = _technical(_numbered(bars), F.col("ret"))
    n_ret, std = F.col("n_ret"), F.col("ret_std")
    ema10, ema30, last = F.col("ema10"), F.col("ema30"), F.col("last")
    zero = F.lit(0.0)

    def autocorr(k: int) -> Column:
        usable = (n_ret > k) & (F.col(f"std_{k}") > FLAT_STD)
        return F.when(usable, F.col(f"corr_{k}")).otherwise(zero)

    return (
        t.withColumns(
            {
                "ema_10_30_cross": F.when(ema30 != 0, ema10 / floored(ema30) - 1.0).otherwise(zero),
                "price_vs_ema10": F.when(ema10 != 0, last / floored(ema10) - 1.0).otherwise(zero),
                "rsi_14": F.when(F.col("n") <= RSI_WINDOW + 1, F.lit(50.0)).otherwise(_rsi()),
                "ret_skew": F.when((n_ret > 2) & (std > FLAT_STD), F.col("skew")).otherwise(zero),
                "ret_kurt": F.when((n_ret > 3) & (std > FLAT_STD), F.col("kurt")).otherwise(zero),
                "autocorr_1": autocorr(1),
                "autocorr_5": autocorr(5),
            }
        )
        .na.fill(0.0)
        .select("session", *TECHNICAL_COLUMNS)
    )


def legacy_block(bars: DataFrame) -> DataFrame:
    """The older twenty columns: six price ratios plus the technical ones for sessions of 20 bars or more."""
    rows = _numbered(bars)
    h, lo = F.max("high"), F.min("low")
    base = rows.groupBy("session").agg(
        (ratio(_last("close"), _first("open")) - 1.0).alias("seen_return"),
        (F.log(_last("close")) - F.log(_first("open"))).alias("log_return"),
        F.stddev_samp("close").alias("seen_volatility"),
        ratio(h, _last("close")).alias("max_high_ratio"),
        ratio(lo, _last("close")).alias("min_low_ratio"),
        ratio(h - lo, _last("close")).alias("high_low_spread"),
    )
    t = _technical(rows.where(F.col("n") >= 20), ratio(F.col("change"), F.col("prev")))
    varies = F.col("ret_std") > FLAT_STD
    advanced = t.select(
        "session",
        "ret_last_5",
        "ret_last_10",
        "ret_last_20",
        (ratio(F.col("ema10"), F.col("ema30")) - 1.0).alias("ema_10_30_cross"),
        (ratio(F.col("last"), F.col("ema10")) - 1.0).alias("price_vs_ema10"),
        _rsi().alias("rsi_14"),
        F.when(varies, F.col("skew")).alias("ret_skew"),
        F.when(varies, F.col("kurt")).alias("ret_kurt"),
        F.when(F.col("std_1") > FLAT_STD, F.col("corr_1")).alias("autocorr_1"),
        F.when(F.col("std_5") > FLAT_STD, F.col("corr_5")).alias("autocorr_5"),
        "fourier_max_freq_amp",
        "fourier_2nd_freq_amp",
        "green_bar_ratio",
        F.col("raw_bar_spread").alias("avg_bar_spread"),
    )
    return base.join(advanced, "session", "left").na.fill(0.0).select("session", *LEGACY_COLUMNS)
