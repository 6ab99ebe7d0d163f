"""Fit on all train sessions, predict splits, and write the validated prediction product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.operators import companies
from tickloom.operators.targets import build_targets
from tickloom.plans import evaluate
from tickloom.plans.blocks import FeatureMatrix, Inputs, build_feature_matrix
from tickloom.plans.design import TARGET, Batch, Design, FoldPlan, build_design, fitted_rows, stretches
from tickloom.plans.experiment import Trial, cross_validate, fit_trials
from tickloom.plans.linear import Fit
from tickloom.plans.moments import numbers
from tickloom.session import materialize
from tickloom.sources import sinks


ALL = FoldPlan(n_folds=1)


@dataclass
class FullModel:
    trial: Trial
    fit: Fit
    design: Design
    feature_count: int


def fit_full(trial: Trial, seen: DataFrame, unseen: DataFrame, headlines: DataFrame) -> FullModel:
    """One trial fitted on every train session."""
    targets = materialize(build_targets(seen, unseen).where(F.col(TARGET).isNotNull()), "targets")
    fm = build_feature_matrix(trial.feature_blocks, Inputs(seen, headlines, targets))
    # No session lies in fold 0, so "train of fold 0" is every session.
    nowhere = targets.select("session", F.lit(0).alias("repeat"), F.lit(-1).alias("fold"))
    design = build_design(fm, targets, nowhere, ALL)
    masks = {cell: (no_train, set()) for cell, (no_train, _) in design.masks().items()}
    fits, counts = fit_trials([trial], fm, design, masks, {trial.name: 0}, {}, True)
    return FullModel(trial, fits[(0, 0, 0)], design, counts[(0, 0, 0)])


def predict(model: FullModel, bars: DataFrame, headlines: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, session, predicted_return, predicted_uncertainty, target_position) for (session, batch) rows.

    Features are session-local, so all batches share one matrix. What depends on the batch follows it: category
    columns below their threshold within a batch are zero there, and positions are sized per batch.
    """
    fm = build_feature_matrix(model.trial.feature_blocks, Inputs(bars, headlines, batches))
    rows = fitted_rows(fm.df, fm, model.design).join(batches.select("session", "batch").distinct(), "session")
    fits = _batch_fits(model, fm, batches)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stretches(parts):
            all_rows, batch, session = Batch(part, ALL), numbers(part, "batch"), numbers(part, "session")
            for value, fit in fits.items():
                mark = batch == value
                if mark.any():
                    rows = all_rows.rows(mark, 0)
                    uncertainty = fit.uncertainty(rows)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "batch": pa.array(batch[mark], pa.int32()),
                            "session": pa.array(session[mark], pa.int64()),
                            "predicted_return": pa.array(fit.predict(rows)),
                            "predicted_uncertainty": pa.array(uncertainty, mask=np.isnan(uncertainty)),
                        }
                    )

    out = rows.mapInArrow(run, "batch int, session long, predicted_return double, predicted_uncertainty double")
    scored = out.withColumn("score", evaluate.score(F.col("predicted_return"), F.col("predicted_uncertainty")))
    sized = evaluate.size_positions(materialize(scored, "scores"), ["batch"], **model.trial.position_sizing)
    return sized.drop("score")


def _batch_fits(model: FullModel, fm: FeatureMatrix, batches: DataFrame) -> dict[int, Fit]:
    """The fit per batch, with the coefficients of category columns that are too rare in the batch set to 0."""
    present = {r["batch"] for r in batches.select("batch").distinct().collect()}
    design = model.design
    names = design.categories.names
    if not names:
        return {b: model.fit for b in present}
    known = batches.sparkSession.createDataFrame([(c,) for c in names], "column string")
    counts = fm.inputs.news.category_counts.join(F.broadcast(known), "column").join(batches.select("session", "batch").distinct(), "session")
    kept = {(r["batch"], r["column"]) for r in companies.frequent_columns(counts, ["batch"]).collect()}  # the model's columns at most
    width = len(model.fit.coef)
    out = {}
    for b in present:
        rare = [len(design.dense) + a * len(names) + i for a in range(len(design.category_aliases)) for i, c in enumerate(names) if (b, c) not in kept]
        out[b] = model.fit.widened(range(width), width, rare)
    return out


@dataclass
class Split:
    name: str
    bars: DataFrame
    headlines: DataFrame

    @property
    def sessions(self) -> DataFrame:
        return self.bars.select("session").distinct()


def predict_splits(model: FullModel, splits: Sequence[Split]) -> dict[str, DataFrame]:
    """Shaped predictions of every split, from one pass over the features of all of them.

    Splits may share session ids: a session is numbered by (id, split) meanwhile. Features belong to a session, categories and sizes to a split.
    """
    n = len(splits)

    def together(frames: Sequence[DataFrame]) -> DataFrame:
        numbered = [df.withColumn("session", F.col("session").cast("long") * n + i) for i, df in enumerate(frames)]
        out = numbered[0]
        for df in numbered[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    batches = together([split.sessions.withColumn("batch", F.lit(i)) for i, split in enumerate(splits)])
    bars, headlines = together([split.bars for split in splits]), together([split.headlines for split in splits])
    predicted = materialize(predict(model, bars, headlines, materialize(batches, "batches")), "predictions")
    own = {split.name: predicted.where(F.col("batch") == i).withColumn("session", F.expr(f"(session - {i}) div {n}")) for i, split in enumerate(splits)}
    return {name: sinks.shape_predictions(rows) for name, rows in own.items()}


def prediction_product(model: FullModel, public: Split, private: Split) -> DataFrame:
    """Both splits predicted, sized separately, united and validated."""
    parts = predict_splits(model, [public, private])
    return sinks.combine_splits(parts[public.name], parts[private.name], public.sessions, private.sessions)


def run_product(
    trial: Trial,
    seen: DataFrame,
    unseen: DataFrame,
    headlines: DataFrame,
    public: Split,
    private: Split,
    out_dir: str,
    plan: FoldPlan = FoldPlan(),
) -> dict[str, str]:
    """Cross-validate, fit on all sessions, predict both splits, and write every output under `out_dir`."""
    cv = cross_validate([trial], seen, unseen, headlines, plan, fail_fast=True)
    sharpe = cv.folds.agg(F.avg("sharpe")).head()[0]
    model = fit_full(trial, seen, unseen, headlines)
    uses_text = any(s.name.startswith("headline") for s in trial.feature_blocks)
    registry = f"{out_dir}/registry"
    paths = {"oof": f"{out_dir}/{trial.name}_oof"}
    sinks.write_csv(cv.oof, paths["oof"])
    parts = predict_splits(model, [public, private])
    both = sinks.combine_splits(parts[public.name], parts[private.name], public.sessions, private.sessions)  # checked before a file is written
    for split in (public, private):
        meta = sinks.prediction_metadata(trial.name, split.name, model.feature_count, sharpe, uses_text)
        paths[split.name] = sinks.save_predictions(
            parts[split.name],
            f"{out_dir}/{trial.name}_{split.name}",
            split.sessions,
            meta,
            registry,
            f"{out_dir}/latest_{split.name}",
        )
    meta = sinks.prediction_metadata(
        trial.name,
        "combined",
        model.feature_count,
        sharpe,
        uses_text,
        source_public=paths[public.name],
        source_private=paths[private.name],
        row_count=both.count(),
    )
    expected = public.sessions.unionByName(private.sessions)
    paths["combined"] = sinks.save_predictions(
        both, f"{out_dir}/{trial.name}_combined", expected, meta, registry, f"{out_dir}/latest_combined"
    )
    return paths
