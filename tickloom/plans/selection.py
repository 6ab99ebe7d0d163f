"""Greedy forward selection of features by out-of-fold Sharpe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom.operators.folds import session_folds
from tickloom.operators.targets import build_targets
from tickloom.plans import evaluate
from tickloom.plans.blocks import FeatureSpec, Inputs, build_feature_matrix
from tickloom.plans.design import TARGET, FoldPlan, build_design
from tickloom.plans.experiment import Trial, _named, _positions, _score, fit_trials, trial_columns, trial_moments
from tickloom.plans.linear import Model
from tickloom.session import materialize


def forward_select(
    seen: DataFrame,
    unseen: DataFrame,
    headlines: DataFrame,
    specs: Sequence[FeatureSpec],
    model: Model,
    max_size: int = 8,
    plan: FoldPlan = FoldPlan(),
    position_sizing: dict | None = None,
) -> DataFrame:
    """(step, feature, mean_cv_sharpe): the feature added at each step and the score it reached.

    The design is written once and its moments are taken once. A step solves every candidate subset from them and scores all of
    them in one job; only one Sharpe per candidate and fold comes back. Category and text columns are candidates like any others; a
    text column is a place in the vocabulary order, whose term may differ by fold.
    """
    targets = materialize(build_targets(seen, unseen).where(F.col(TARGET).isNotNull()), "targets")
    folds = materialize(session_folds(targets, plan.n_folds, plan.seed, plan.n_repeats), "folds")
    fm = build_feature_matrix(list(specs), Inputs(seen, headlines, targets))
    design = build_design(fm, targets, folds, plan)
    masks = design.masks()
    every = Trial("all", tuple(specs), model)
    columns = trial_columns(every, fm, design)
    moments = trial_moments([every], design)

    chosen: list[str] = []
    steps = []
    while len(chosen) < min(max_size, len(columns)):
        candidates = [c for c in columns if c not in chosen]
        trials = [Trial(c, tuple(specs), model, position_sizing or {}, (*chosen, c)) for c in candidates]
        numbers = {t.name: n for n, t in enumerate(trials)}
        fits, _ = fit_trials(trials, fm, design, masks, numbers, {}, False, moments)
        if not fits:
            break
        oof = _positions(_named(_score(design, fits), numbers, plan), trials)
        scores = evaluate.fold_sharpes(oof, ["experiment_name", "repeat", "fold"])
        best = (
            scores.groupBy("experiment_name")
            .agg(F.avg("sharpe").alias("mean_cv_sharpe"))
            .orderBy(F.col("mean_cv_sharpe").desc(), "experiment_name")
            .head()
        )
        chosen.append(best["experiment_name"])
        steps.append((len(chosen), best["experiment_name"], best["mean_cv_sharpe"]))
    return seen.sparkSession.createDataFrame(steps, "step int, feature string, mean_cv_sharpe double")
