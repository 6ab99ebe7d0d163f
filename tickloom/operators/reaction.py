"""News against prices: reactions after headlines and price regime before them.

Headlines meet bars as event cells, so one hot bar or company is a handful of counted rows by the
time of the join, and every mean over headlines is a count-weighted mean over cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tickloom.functions.numeric import double, floored, ratio, ratio_or
from tickloom.operators.targets import last_close

# Output column names.
REACTION_COLUMNS = [
    "headline_price_agreement_mean",
    "headline_price_next_bar_agreement_mean",
    "headline_price_agreement_weighted",
    "headline_signed_seen_reaction_weighted",
    "headline_signed_next_bar_reaction_weighted",
    "high_relevance_signed_seen_reaction_mean",
    "high_relevance_agreement_mean",
    "positive_headline_seen_return_mean",
    "negative_headline_seen_return_mean",
    "burst_bar_share",
    "burst_window_volatility",
    "burst_window_volatility_ratio",
    "burst_window_range_mean",
]

# Output column names.
REGIME_COLUMNS = [
    "pre_event_return_1_mean",
    "pre_event_return_3_mean",
    "pre_event_return_5_mean",
    "pre_event_vol_3_mean",
    "pre_event_vol_5_mean",
    "pre_event_range_3_mean",
    "pre_event_range_5_mean",
    "pre_event_drawdown_mean",
    "weighted_pre_event_return_3_mean",
    "weighted_pre_event_return_5_mean",
    "weighted_pre_event_vol_3_mean",
    "weighted_pre_event_vol_5_mean",
    "weighted_contrarian_return_3_mean",
    "weighted_contrarian_return_5_mean",
    "weighted_drawdown_contrarian_mean",
    "weighted_vol_scaled_polarity_3_mean",
    "weighted_vol_scaled_polarity_5_mean",
    "positive_pre_event_return_3_mean",
    "negative_pre_event_return_3_mean",
    "positive_pre_event_drawdown_mean",
    "negative_pre_event_drawdown_mean",
]


def _by_bar() -> WindowSpec:
    return Window.partitionBy("session").orderBy("bar_ix")


def _priced(bars: DataFrame) -> DataFrame:
    prices = bars.where(F.col("session").isNotNull()).select(
        "session", "bar_ix", *[double(c).alias(c) for c in ("open", "high", "low", "close")]
    )
    previous = F.lag("close").over(_by_bar())
    return prices.withColumns(
        {
            "bar_return": F.coalesce(ratio(F.col("close") - previous, previous), F.lit(0.0)),
            "intrabar_range_ratio": (F.col("high") - F.col("low")) / floored(F.col("open")),
        }
    )


def reaction_context(bars: DataFrame) -> DataFrame:
    """Per bar: return, range, return to the next close and to the last seen close."""
    priced = _priced(bars)
    last = bars.groupBy("session").agg(last_close("__end"))
    following = F.lead("close").over(_by_bar())
    close = F.col("close")
    return (
        priced.withColumn("__next", following)
        .join(last, "session")
        .select(
            "session",
            "bar_ix",
            "bar_return",
            "intrabar_range_ratio",
            F.coalesce((F.col("__next") - close) / floored(close), F.lit(0.0)).alias("next_close_return"),
            ((double("__end") - close) / floored(close)).alias("return_to_seen_end"),
        )
    )


def _top_company(scored: DataFrame) -> DataFrame:
    """The company of relevance rank 1 per session (ties by company)."""
    order = F.struct((-F.round("relevance_score", 12)).alias("s"), F.col("company").alias("c"))
    return scored.groupBy("session").agg(F.min_by("company", order).alias("top_company"))


def _event_cells(cells: DataFrame, context: DataFrame, scored: DataFrame) -> DataFrame:
    """Cells of active polarity with bar context and company relevance (nulls of relevance to 0)."""
    return (
        cells.select("session", "company", "bar_ix", "n_pos", "n_neg")
        .where(F.col("n_pos") + F.col("n_neg") > 0)
        .join(context, ["session", "bar_ix"], "left")
        .join(scored.select("session", "company", "relevance_weight"), ["session", "company"], "left")
        .na.fill(0.0, ["relevance_weight"])
    )


def agreement_features(cells: DataFrame, context: DataFrame, scored: DataFrame) -> DataFrame:
    """The nine agreement and reaction columns of sessions with a non-neutral headline.

    Plain means skip headlines without a bar; the weighted forms become 0 when any has none.
    """
    joined = _event_cells(cells, context, scored).join(_top_company(scored), "session", "left")
    pos, neg, w = F.col("n_pos"), F.col("n_neg"), F.col("relevance_weight")
    seen, following = F.col("return_to_seen_end"), F.col("next_close_return")
    active, net = pos + neg, pos - neg
    top = F.col("company") == F.col("top_company")

    def mean(x: Column, when: Column | None = None) -> Column:
        """Mean of polarity * x over headlines with a bar."""
        keep = x.isNotNull() if when is None else x.isNotNull() & when
        return ratio_or(F.sum(F.when(keep, net * x)), F.sum(F.when(keep, active)))

    def one_sided(count: Column) -> Column:
        return ratio_or(F.sum(count * seen), F.sum(F.when(seen.isNotNull(), count)))

    def weighted(x: Column) -> Column:
        total = F.sum(w * active)
        missing = F.sum(F.when(x.isNull(), active)) > 0
        value = F.when(missing, F.lit(0.0)).otherwise(ratio(F.sum(w * net * x), total))
        return F.when(total > 0, value).otherwise(mean(x))

    return joined.groupBy("session").agg(
        mean(F.signum(seen)).alias("headline_price_agreement_mean"),
        mean(F.signum(following)).alias("headline_price_next_bar_agreement_mean"),
        weighted(F.signum(seen)).alias("headline_price_agreement_weighted"),
        weighted(seen).alias("headline_signed_seen_reaction_weighted"),
        weighted(following).alias("headline_signed_next_bar_reaction_weighted"),
        mean(seen, top).alias("high_relevance_signed_seen_reaction_mean"),
        mean(F.signum(seen), top).alias("high_relevance_agreement_mean"),
        one_sided(pos).alias("positive_headline_seen_return_mean"),
        one_sided(neg).alias("negative_headline_seen_return_mean"),
    )


def burst_features(cells: DataFrame, context: DataFrame) -> DataFrame:
    """Share, volatility and range of bars whose three-bar neighbourhood holds two or more headlines."""
    counts = cells.groupBy("session", "bar_ix").agg(F.sum("n").alias("__n"))
    around = F.sum(F.coalesce("__n", F.lit(0.0))).over(_by_bar().rowsBetween(-1, 1))
    rows = context.join(counts, ["session", "bar_ix"], "left").withColumn("burst", around >= 2)
    burst, ret = F.col("burst"), F.col("bar_return")
    zero = F.lit(0.0)
    agg = rows.groupBy("session").agg(
        F.avg(burst.cast("double")).alias("burst_bar_share"),
        F.coalesce(F.stddev_pop(F.when(burst, ret)), zero).alias("burst_window_volatility"),
        F.stddev_pop(ret).alias("__all"),
        F.coalesce(F.avg(F.when(burst, F.col("intrabar_range_ratio"))), zero).alias("burst_window_range_mean"),
    )
    return agg.withColumn(
        "burst_window_volatility_ratio", F.col("burst_window_volatility") / floored(F.col("__all"))
    ).drop("__all")


def reaction_features(cells: DataFrame, scored: DataFrame, bars: DataFrame) -> DataFrame:
    """The thirteen text-price interaction columns for sessions with headlines."""
    context = reaction_context(bars)
    sessions = cells.select("session").distinct()
    return (
        sessions.join(agreement_features(cells, context, scored), "session", "left")
        .join(burst_features(cells, context), "session", "left")
        .na.fill(0.0)
        .select("session", *REACTION_COLUMNS)
    )


def regime_context(bars: DataFrame) -> DataFrame:
    """Per bar, from earlier bars only: returns over 1/3/5 bars, trailing volatility and range, drawdown."""
    w = _by_bar()
    close = F.col("close")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.lag(close).over(w)
    out = {
        "pre_event_drawdown": previous / floored(F.max(close).over(before)) - 1.0,
    }
    for k in (1, 3, 5):
        start = F.lag(close, k + 1).over(w)
        out[f"pre_event_return_{k}"] = (previous - start) / floored(start)
    for k in (3, 5):
        trailing = w.rowsBetween(-k, -1)
        out[f"pre_event_vol_{k}"] = F.stddev_pop("bar_return").over(trailing)
        out[f"pre_event_range_{k}"] = F.avg("intrabar_range_ratio").over(trailing)
    return _priced(bars).withColumns(out).select("session", "bar_ix", *out)


def regime_features(cells: DataFrame, scored: DataFrame, bars: DataFrame) -> DataFrame:
    """The twenty-one pre-event regime columns for sessions with headlines; nulls count as 0 before averaging."""
    context = regime_context(bars)
    names = [c for c in context.columns if c.startswith("pre_event_")]
    joined = _event_cells(cells, context, scored).na.fill(0.0, names)
    pos, neg, w = F.col("n_pos"), F.col("n_neg"), F.col("relevance_weight")
    active, net = pos + neg, pos - neg
    total, weight = F.sum(active), F.sum(w * active)

    def weighted(count: Column, x: Column) -> Column:
        return F.when(weight > 0, ratio(F.sum(w * count * x), weight)).otherwise(ratio(F.sum(count * x), total))

    aggs = {f"{n}_mean": ratio(F.sum(active * F.col(n)), total) for n in names}
    for n in ("pre_event_return_3", "pre_event_return_5", "pre_event_vol_3", "pre_event_vol_5"):
        aggs[f"weighted_{n}_mean"] = weighted(active, F.col(n))
    for k in (3, 5):
        aggs[f"weighted_contrarian_return_{k}_mean"] = weighted(-net, F.col(f"pre_event_return_{k}"))
        scaled = F.lit(1.0) / floored(F.col(f"pre_event_vol_{k}"))
        aggs[f"weighted_vol_scaled_polarity_{k}_mean"] = weighted(net, scaled)
    aggs["weighted_drawdown_contrarian_mean"] = weighted(-net, F.col("pre_event_drawdown"))
    for side, count in (("positive", pos), ("negative", neg)):
        for n in ("pre_event_return_3", "pre_event_drawdown"):
            aggs[f"{side}_{n}_mean"] = ratio_or(F.sum(count * F.col(n)), F.sum(count))
    features = joined.groupBy("session").agg(*[c.alias(n) for n, c in aggs.items()])
    sessions = cells.select("session").distinct()
    return sessions.join(features, "session", "left").na.fill(0.0).select("session", *REGIME_COLUMNS)
