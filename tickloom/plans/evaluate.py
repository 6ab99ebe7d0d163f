"""Scores, position sizes, fold Sharpe ratios, repeat summaries and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import clipped
from tickloom.functions.ranking import exact_percentile
from tickloom.operators.targets import sharpe

# Smallest score divisor, largest position and the default sizing percentile.
MIN_DENOMINATOR = 1e-6
POSITION_CLIP = 100.0
PERCENTILE = 90.0


def score(predicted: Column, uncertainty: Column | None = None) -> Column:
    """predicted / max(|uncertainty|, 1e-6); the prediction itself where there is no uncertainty."""
    if uncertainty is None:
        return predicted
    size = F.greatest(F.abs(uncertainty), F.lit(MIN_DENOMINATOR))
    return F.when(uncertainty.isNull(), predicted).otherwise(predicted / size)


def size_positions(
    scored: DataFrame,
    keys: Sequence[str],
    column: str = "score",
    percentile: float = PERCENTILE,
    neutral_band: float = 0.0,
    max_abs_position: float = POSITION_CLIP,
) -> DataFrame:
    """Add `target_position`: the score over its batch's percentile of |score|, clipped to ±1, times the cap.

    A batch is one value of `keys`: batches are few (trials times folds, or splits), so their scales are broadcast.
    The scale is exact, computed without gathering a batch in one task; it is 1 where the percentile is
    missing or below 1e-6.
    """
    s = F.col(column)
    if neutral_band > 0:
        s = F.when(F.abs(s) >= neutral_band, s).when(s.isNotNull(), F.lit(0.0))
    rows = scored.withColumn("__s", s).withColumn("__a", F.abs("__s"))
    scale = exact_percentile(rows, keys, "__a", percentile / 100.0, "__scale", few_groups=True)
    scale = F.broadcast(scale)
    joined = rows.join(scale, list(keys), "left") if keys else rows.crossJoin(scale)
    divisor = F.when(F.col("__scale") >= MIN_DENOMINATOR, F.col("__scale")).otherwise(F.lit(1.0))
    position = clipped(F.col("__s") / divisor, -1.0, 1.0) * max_abs_position
    return joined.withColumn("target_position", position).drop("__s", "__a", "__scale")


def fold_sharpes(oof: DataFrame, keys: Sequence[str] = ("repeat", "seed", "fold")) -> DataFrame:
    return oof.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"), sharpe(F.col("pnl")).alias("sharpe"))


def average_repeats(oof: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per session over repeated folds: mean predictions and positions, count, pnl recomputed."""
    out = oof.groupBy(*keys, "session").agg(
        F.avg("predicted_return").alias("predicted_return"),
        F.avg("predicted_uncertainty").alias("predicted_uncertainty"),
        F.avg("target_position").alias("target_position"),
        F.min_by("realized_return", "repeat").alias("realized_return"),
        F.count(F.lit(1)).cast("double").alias("cv_prediction_count"),
    )
    return out.withColumn("pnl", F.col("target_position") * F.col("realized_return"))


def repeat_summary(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean Sharpe per (repeat, seed)."""
    return folds.groupBy(*keys, "repeat", "seed").agg(F.avg("sharpe").alias("mean_sharpe"))


def repeat_spread(repeats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return repeats.groupBy(*keys).agg(
        F.avg("mean_sharpe").alias("mean_cv_sharpe"), F.stddev_pop("mean_sharpe").alias("std_cv_sharpe")
    )


def leaderboard(folds: DataFrame, name: str = "experiment_name") -> DataFrame:
    """Mean and population std of the fold Sharpe per experiment, ranked from 1."""
    table = folds.groupBy(name).agg(
        F.avg("sharpe").alias("mean_cv_sharpe"),
        F.stddev_pop("sharpe").alias("std_cv_sharpe"),
        F.avg("feature_count").alias("mean_feature_count"),
        F.countDistinct("fold").cast("double").alias("cv_folds"),
    )
    return with_rank(table, "mean_cv_sharpe", name)


def model_leaderboard(folds: DataFrame, name: str = "model") -> DataFrame:
    """The older model table: mean train and valid Sharpe, sample std, mean gap and fit seconds."""
    table = folds.groupBy(name).agg(
        F.avg("train_sharpe").alias("mean_train_sharpe"),
        F.avg("valid_sharpe").alias("mean_valid_sharpe"),
        F.stddev_samp("valid_sharpe").alias("std_valid_sharpe"),
        F.avg(F.col("train_sharpe") - F.col("valid_sharpe")).alias("mean_gap"),
        F.avg("fit_seconds").alias("mean_fit_seconds"),
    )
    return with_rank(table, "mean_valid_sharpe", name)


def board_ends(board: DataFrame, by: str, n: int, name: str = "experiment_name") -> DataFrame:
    """The best and the worst n rows of a leaderboard under one metric: (end, place, ...). Rows without the metric are left out.

    A leaderboard has one row per trial.
    """
    rows = board.where(F.col(by).isNotNull())
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(by).desc(), name)))
    low = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(by).asc(), F.col(name).desc())))
    ends = [d.where(F.col("place") <= n).withColumn("end", F.lit(e)) for d, e in ((top, "head"), (low, "tail"))]
    return ends[0].unionByName(ends[1]).select("end", "place", *board.columns)


def best_by_metric(board: DataFrame, metrics: Sequence[str], name: str = "experiment_name") -> DataFrame:
    """(metric, experiment, value): the winner of every metric, ties to the first by name."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("c")
    long = board.select(name, cells).select(name, "c.*").where(F.col("value").isNotNull())
    nth = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("value").desc(), name))
    return long.withColumn("__n", nth).where("__n = 1").select("metric", name, "value")


def with_rank(table: DataFrame, by: str, name: str) -> DataFrame:
    """1-based rank, best first. A leaderboard has one row per trial, so one task orders it."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(by).desc_nulls_last(), name)
    return table.withColumn("rank", F.row_number().over(order))


def ensemble_average(members: DataFrame, value: str = "predicted_return") -> DataFrame:
    """Mean prediction per session over the union of the members' predictions."""
    return members.groupBy("session").agg(
        F.avg(value).alias(value), F.count(F.lit(1)).cast("double").alias("n_members")
    )
