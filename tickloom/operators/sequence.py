"""Headline timing and polarity-sequence statistics per session or per (session, company)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.functions.numeric import ratio, ratio_or
from tickloom.operators.events import session_last_bar

# Output column names.
SEQUENCE_COLUMNS = [
    "polarity_flip_count",
    "polarity_flip_rate",
    "time_since_last_strong_event",
    "headline_gap_mean",
    "headline_gap_cv",
    "headline_burstiness",
    "max_headlines_single_bar",
    "multi_headline_bar_count",
    "multi_headline_bar_share",
]


def polarity_flips(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sign changes between consecutive non-neutral headlines ordered by (bar, headline text).

    Equal headlines have equal polarity, so copies collapse first. The distinct rows are
    range-partitioned on the full order, which splits a large session over many partitions; each
    partition's stretch of a session becomes one summary row, and the stretches are chained.
    """
    keys = list(keys)
    spark = parsed.sparkSession
    distinct = (
        parsed.where(F.col("polarity") != 0)
        .select(*keys, "bar_ix", "headline", F.signum(F.col("polarity").cast("double")).alias("s"))
        .distinct()
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(parts, *keys, "bar_ix", "headline").withColumn(
        "__part", F.spark_partition_id()
    )
    order = [F.col("bar_ix"), F.col("headline")]
    inside = Window.partitionBy(*keys, "__part").orderBy(*order)
    stretches = (
        ranged.withColumn("__prev", F.lag("s").over(inside))
        .groupBy(*keys, "__part")
        .agg(
            F.sum((F.col("s") != F.coalesce("__prev", "s")).cast("double")).alias("flips"),
            F.min_by("s", F.struct(*order)).alias("head"),
            F.max_by("s", F.struct(*order)).alias("tail"),
        )
    )
    chain = Window.partitionBy(*keys).orderBy("__part")
    before = F.lag("tail").over(chain)
    joined = stretches.withColumn("seam", (F.col("head") != F.coalesce(before, F.col("head"))).cast("double"))
    return joined.groupBy(*keys).agg(F.sum(F.col("flips") + F.col("seam")).alias("polarity_flip_count"))


def sequence_features(parsed: DataFrame, cells: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The nine sequence statistics from event cells (one row per occupied bar) and the flip counts.

    Consecutive headlines of one bar are zero apart, so gap moments need only the occupied bars and
    the headline count: n-1 gaps in all, the non-zero ones between neighbouring occupied bars.
    """
    keys = list(keys)
    bars = cells.groupBy(*keys, "bar_ix").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n_pos") + F.col("n_neg")).alias("n_active"),
        F.sum("n_strong").alias("n_strong"),
    )
    by_bar = Window.partitionBy(*keys).orderBy("bar_ix")
    gap = (F.col("bar_ix") - F.lag("bar_ix").over(by_bar)).cast("double")
    agg = (
        bars.withColumn("gap", gap)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_active").alias("n_active"),
            F.sum("gap").alias("gap_sum"),
            F.sum(F.col("gap") * F.col("gap")).alias("gap_sq"),
            F.max(F.when(F.col("n_strong") > 0, F.col("bar_ix"))).alias("last_strong"),
            F.max("n").alias("max_headlines_single_bar"),
            F.sum((F.col("n") >= 2).cast("double")).alias("multi_headline_bar_count"),
        )
    )
    agg = agg.join(polarity_flips(parsed, keys), keys, "left").join(session_last_bar(cells), "session")

    zero = F.lit(0.0)
    gaps = F.col("n") - 1
    mean = F.coalesce(ratio(F.coalesce("gap_sum", zero), gaps), zero)
    agg = agg.withColumn("headline_gap_mean", mean)
    mean = F.col("headline_gap_mean")
    variance = ratio(F.coalesce("gap_sq", zero), gaps) - mean * mean
    agg = agg.withColumn("__std", F.sqrt(F.greatest(F.coalesce(variance, zero), zero)))
    std, last = F.col("__std"), F.col("session_max_bar")
    flips = F.coalesce("polarity_flip_count", zero)
    return agg.select(
        *keys,
        flips.alias("polarity_flip_count"),
        F.when(F.col("n_active") > 1, flips / F.greatest(F.col("n_active") - 1, F.lit(1.0)))
        .otherwise(zero)
        .alias("polarity_flip_rate"),
        F.coalesce(last - F.col("last_strong"), last + 1.0).alias("time_since_last_strong_event"),
        "headline_gap_mean",
        (std / F.greatest(mean, F.lit(1.0))).alias("headline_gap_cv"),
        ratio_or(std - mean, std + mean).alias("headline_burstiness"),
        "max_headlines_single_bar",
        "multi_headline_bar_count",
        (F.col("multi_headline_bar_count") / F.greatest(last + 1.0, F.lit(1.0))).alias("multi_headline_bar_share"),
    )
