"""Sweeps of linear position models: hundreds of trials from one pass of moments.

The position is the prediction itself, so mean and variance of the pnl follow from the moments of a session
set, and train and held-out Sharpe of every trial need no further look at the rows.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom.operators.folds import holdout_split, session_folds
from tickloom.operators.price import LEGACY_COLUMNS, legacy_block
from tickloom.operators.targets import build_targets, regression_metrics, sharpe
from tickloom.plans import forest
from tickloom.plans.evaluate import model_leaderboard, with_rank
from tickloom.plans.linear import Fit, Model, position_sharpe
from tickloom.plans.moments import ONE, Y_SQUARED, Moments, collect_moments
from tickloom.session import materialize

TARGET = "target_return"


def legacy_design(seen: DataFrame, unseen: DataFrame) -> DataFrame:
    """Older feature block with the target, one row per session that has both."""
    targets = build_targets(seen, unseen).select("session", TARGET).where(F.col(TARGET).isNotNull())
    return legacy_block(seen).join(targets, "session")


def fold_position_sharpes(
    design: DataFrame, columns: Sequence[str], models: dict[str, Model], folds: DataFrame, valid_folds: Sequence[int]
) -> DataFrame:
    """(model, fold, train_sharpe, valid_sharpe, gap, fit_seconds) of every model and held-out fold."""
    rows = design.join(folds.select("session", "fold"), "session")
    kinds = [ONE, Y_SQUARED, *dict.fromkeys(k for m in models.values() for k in m.kinds() if k not in (ONE, Y_SQUARED))]
    got = collect_moments(rows, columns, TARGET, ["fold"], kinds)
    cells = sorted({f for _, _, f in got})

    def total(k: int) -> Moments:
        out = got[(k, 0, cells[0])]
        for f in cells[1:]:
            out = out + got[(k, 0, f)]
        return out

    totals = [total(k) for k in range(len(kinds))]
    out = []
    for name, model in models.items():
        for f in valid_folds:
            train = [t - got[(k, 0, f)] for k, t in enumerate(totals)]
            started = time.perf_counter()
            fit = model.solve([train[kinds.index(k)] for k in model.kinds()])
            seconds = time.perf_counter() - started
            a = position_sharpe(fit, train[0], train[1])
            b = position_sharpe(fit, got[(0, 0, f)], got[(1, 0, f)])
            out.append((name, f, float(a), float(b), float(a - b), seconds))
    return design.sparkSession.createDataFrame(
        out, "model string, fold int, train_sharpe double, valid_sharpe double, gap double, fit_seconds double"
    )


def holdout_sweep(seen: DataFrame, unseen: DataFrame, models: dict[str, Model], seed: int = 42) -> DataFrame:
    """Ranked table of all models on one 80/20 split."""
    design = materialize(legacy_design(seen, unseen), "legacy")
    folds = session_folds(design, 5, seed)
    table = fold_position_sharpes(design, LEGACY_COLUMNS, models, folds, [0])
    return with_rank(table.drop("fold").withColumnRenamed("valid_sharpe", "val_sharpe"), "val_sharpe", "model")


def cv_sweep(seen: DataFrame, unseen: DataFrame, models: dict[str, Model], n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Leaderboard of all models over k folds."""
    design = materialize(legacy_design(seen, unseen), "legacy")
    folds = session_folds(design, n_folds, seed)
    table = fold_position_sharpes(design, LEGACY_COLUMNS, models, folds, range(n_folds))
    return model_leaderboard(table)


def fit_positions(design: DataFrame, columns: Sequence[str], model: Model) -> Fit:
    """One model on all rows."""
    kinds = list(dict.fromkeys(model.kinds()))
    got = collect_moments(design.withColumn("cell", F.lit(0)), columns, TARGET, ["cell"], kinds)
    return model.solve([got[(kinds.index(k), 0, 0)] for k in model.kinds()])


def linear_scores(features: DataFrame, columns: Sequence[str], fit: Fit, scale: float = 1.0) -> DataFrame:
    """(session, target_position) = scale * (intercept + coef . x) as one native expression."""
    terms = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) * float(b) for c, b in zip(columns, fit.coef) if b != 0.0]
    value = F.lit(float(fit.intercept))
    for term in terms:
        value = value + term
    return features.select("session", (value * scale).alias("target_position"))


def score_by_table(long: DataFrame, coefs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Linear scores from long features (session, feature, value) and a coefficient table (keys, feature, coef).

    The row with feature '(intercept)' is added once. Features without a coefficient contribute nothing.
    """
    keys = list(keys)
    intercepts = coefs.where(F.col("feature") == "(intercept)").select(*keys, F.col("coef").alias("__b0"))
    slopes = coefs.where(F.col("feature") != "(intercept)")
    sums = long.join(slopes, "feature").groupBy(*keys, "session").agg(F.sum(F.col("value") * F.col("coef")).alias("__s"))
    joined = sums.join(intercepts, keys) if keys else sums.crossJoin(F.broadcast(intercepts))
    return joined.select(*keys, "session", (F.col("__b0") + F.col("__s")).alias("predicted_return"))


def random_forest(seen: DataFrame, unseen: DataFrame, trees: int = 100, depth: int = 5, seed: int = 42):
    """Forest on the older block, 80/20 split: (importances, R2/MSE/Sharpe per side)."""
    design = legacy_design(seen, unseen)
    rows = materialize(design.join(holdout_split(design, seed), "session"), "forest")
    model = forest.grow(rows.where(~F.col("is_valid")), LEGACY_COLUMNS, TARGET, trees, depth, seed)
    scored = forest.predict(rows, model, ["session", "is_valid", TARGET])
    table = seen.sparkSession.createDataFrame(model.importances(), "feature string, importance double")
    value = F.col("prediction") * F.col(TARGET)
    metrics = regression_metrics(scored, "prediction", TARGET, ["is_valid"]).join(
        scored.groupBy("is_valid").agg(sharpe(value).alias("sharpe")), "is_valid"
    )
    return table, metrics
