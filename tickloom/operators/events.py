"""Event table and its compact cells.

A session or company may hold most of all headlines. Event flags depend on a headline only through its bar
and polarity, so everything downstream works on *cells*: one row per (session, company, bar) with
counts and sums, reduced map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.numeric import flag
from tickloom.functions.text import parse_headlines

RECENT_BARS = 9
VERY_RECENT_BARS = 4


def strong_event():
    family = F.col("event_family")
    detailed = (F.col("has_pct") > 0) | (F.col("has_amount") > 0) | ~family.endswith("_other")
    return (F.col("polarity") != 0) & detailed


def timing_flags(bar="bar_ix", session_max="session_max_bar") -> dict:
    """Recency and half flags of a bar, relative to the session's last headline bar."""
    from_end = F.col(session_max) - F.col(bar).cast("double")
    fraction = F.col(bar).cast("double") / F.greatest(F.col(session_max), F.lit(1.0))
    return {
        "bars_from_end": from_end,
        "bar_fraction": fraction,
        "is_recent": flag(from_end <= RECENT_BARS),
        "is_very_recent": flag(from_end <= VERY_RECENT_BARS),
        "is_early_half": flag(fraction <= 0.5),
        "is_late_half": 1.0 - flag(fraction <= 0.5),
    }


def session_last_bar(frame: DataFrame) -> DataFrame:
    """Last headline bar per session (map-side combined)."""
    return frame.groupBy("session").agg(F.max("bar_ix").cast("double").alias("session_max_bar"))


def parsed_events(headlines: DataFrame) -> DataFrame:
    """Parsed headlines of non-null sessions; the row-local part of the event table."""
    return parse_headlines(headlines.where(F.col("session").isNotNull()))


def event_table(headlines: DataFrame) -> DataFrame:
    """Every headline with its fifteen parsed and eighteen derived columns."""
    parsed = parsed_events(headlines)
    last = session_last_bar(headlines.where(F.col("session").isNotNull()))
    polarity, recent = F.col("polarity"), F.col("is_recent")
    return (
        parsed.join(last, "session", "left")
        .withColumns(
            {
                "polarity_abs": F.abs("polarity"),
                "positive_flag": flag(polarity > 0),
                "negative_flag": flag(polarity < 0),
                "neutral_flag": flag(polarity == 0),
                "pct_abs": F.abs("pct"),
                "pct_signed": F.col("pct") * polarity,
                **timing_flags(),
                "is_strong_event": flag(strong_event()),
            }
        )
        .withColumns(
            {
                "late_positive_flag": F.col("positive_flag") * recent,
                "late_negative_flag": F.col("negative_flag") * recent,
                "late_neutral_flag": F.col("neutral_flag") * recent,
                "late_strong_flag": F.col("is_strong_event") * recent,
            }
        )
    )


def event_cells(parsed: DataFrame) -> DataFrame:
    """One row per (session, company, bar_ix): counts by polarity, strong count, amount and percent sums."""
    polarity = F.col("polarity")
    pct, amount = F.col("pct"), F.col("amount_m")
    return parsed.groupBy("session", "company", "bar_ix").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(flag(polarity > 0)).alias("n_pos"),
        F.sum(flag(polarity < 0)).alias("n_neg"),
        F.sum(flag(strong_event())).alias("n_strong"),
        F.sum(amount).alias("amount_sum"),
        F.max(amount).alias("amount_max"),
        F.sum(pct).alias("pct_sum"),
        F.sum(F.abs(pct)).alias("pct_abs_sum"),
        F.max(F.abs(pct)).alias("pct_abs_max"),
        F.sum(pct * polarity).alias("pct_signed_sum"),
        F.sum(F.col("has_amount")).cast("double").alias("n_amount"),
        F.sum(F.col("has_pct")).cast("double").alias("n_pct"),
    )


def with_timing(cells: DataFrame) -> DataFrame:
    """Cells with the session's last headline bar and the timing flags."""
    return cells.join(session_last_bar(cells), "session").withColumns(timing_flags())
