"""Cross-validated experiments and sweeps: many trials from one design and one pass of moments.

Folds are a column, not a loop over data. Train moments of a fold are the total minus the fold's own, for every
model and feature subset at once; TF-IDF columns, whose vocabulary depends on the fold, are sparse entries of their fold.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.operators.folds import session_folds
from tickloom.operators.targets import build_targets
from tickloom.plans import evaluate
from tickloom.plans.blocks import FeatureMatrix, FeatureSpec, Inputs, build_feature_matrix, check_specs
from tickloom.plans.design import TARGET, Batch, Design, FoldPlan, Sums, build_design, dense_shift, design_moments, stretches
from tickloom.plans.linear import STANDARDISED_ALPHA, Fit, Model, uncertainty_ridge
from tickloom.plans.moments import ONE, Moments, numbers, sum_vectors
from tickloom.session import materialize
from tickloom.sources import sinks

QUANTILE_SHIFTS = (42, 21, 0)  # the 63 bits of a number from 0 on, 21 at a time


@dataclass(frozen=True)
class Trial:
    """One experiment: feature blocks, a model, and how positions are sized.

    `columns` keeps only the listed matrix columns of the blocks, or those for which a function of the name holds.
    """

    name: str
    feature_blocks: tuple[FeatureSpec, ...]
    model: Model
    position_sizing: dict = field(default_factory=dict)
    columns: tuple[str, ...] | Callable[[str], bool] | None = None
    config_path: str = ""  # where the trial was described, for the reports


def trial_grid(prefix: str, features: dict[str, Sequence[FeatureSpec]], models: dict[str, Model], **sizing) -> list[Trial]:
    """The product of named feature sets and named models."""
    return [
        Trial(f"{prefix}__{f}__{m}", tuple(blocks), model, dict(sizing))
        for (f, blocks), (m, model) in product(features.items(), models.items())
    ]


def trial_table(spark, trials: Sequence[Trial]) -> DataFrame:
    rows = [(t.name, t.config_path, ",".join(s.resolved_alias for s in t.feature_blocks), t.model.name) for t in trials]
    return spark.createDataFrame(rows, "experiment_name string, config_path string, feature_blocks string, model string")


@dataclass
class Results:
    folds: DataFrame  # experiment, repeat, seed, fold, n_train, n_valid, feature_count, sharpe
    oof: DataFrame  # experiment, session, predictions, position, pnl, repeat, seed, fold
    errors: dict[str, str]
    elapsed: dict[str, float]  # seconds of each trial: its own solving, and an even share of what its list did together

    def leaderboard(self, trials: Sequence[Trial]) -> DataFrame:
        """Successful trials by mean Sharpe, then failed ones with their message."""
        spark = self.folds.sparkSession
        times = spark.createDataFrame(list(self.elapsed.items()), "experiment_name string, elapsed_seconds double")
        board = evaluate.leaderboard(self.folds).join(trial_table(spark, trials), "experiment_name")
        ok = board.join(F.broadcast(times), "experiment_name").withColumns({"status": F.lit("ok"), "error": F.lit("")})
        failed = spark.createDataFrame(list(self.errors.items()), "experiment_name string, error string")
        failed = failed.join(trial_table(spark, trials).select("experiment_name", "config_path"), "experiment_name")
        failed = failed.withColumns({"status": F.lit("error"), "model": F.lit(""), "feature_blocks": F.lit("")})
        return ok.unionByName(failed, allowMissingColumns=True).orderBy(
            F.col("status") != "ok", F.col("mean_cv_sharpe").desc_nulls_last(), "experiment_name"
        )

    def fold_report(self, trials: Sequence[Trial]) -> DataFrame:
        """Every fold's score with what was fitted."""
        named = trial_table(self.folds.sparkSession, trials).join(self.folds, "experiment_name")
        return named.orderBy("experiment_name", "repeat", "fold")


def write_reports(results: Results, trials: Sequence[Trial], folder: str, stamp: str | None = None) -> dict[str, str]:
    """Leaderboard and fold scores as CSV under `folder`, named by a UTC stamp, and again as the latest ones."""
    stamp = stamp or dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%SZ")
    paths = {}
    for name, report in (("experiment_sweep", results.leaderboard(trials)), ("experiment_sweep_folds", results.fold_report(trials))):
        paths[name] = f"{folder}/{stamp}_{name}"
        sinks.write_csv(report.coalesce(1), paths[name], f"{folder}/latest_{name}")  # one row a trial, or a trial and fold
    return paths


def trial_columns(trial: Trial, fm: FeatureMatrix, design: Design) -> list[str]:
    """The columns of a trial's blocks: plain ones, then category columns, then text columns."""
    out = [c for s in trial.feature_blocks for c in design.block_columns(s.resolved_alias, fm)]
    if trial.columns is None:
        return out
    keep = trial.columns if callable(trial.columns) else set(trial.columns).__contains__
    return [c for c in out if keep(c)]


def _residuals(batch: Batch, fits: dict[tuple[int, int, int], Fit], plan: FoldPlan):
    """Every fit with its train rows and their target minus prediction."""
    sides = {}
    for key, fit in fits.items():
        r, f = key[1:]
        if (r, f) not in sides:
            mark = batch.side(r, f, valid=False)
            sides[(r, f)] = batch.rows(mark, r * plan.n_folds + f), batch.y[mark]
        rows, y = sides[(r, f)]
        yield key, rows, y - fit.predict(rows)


def _log_sums(design: Design, fits: dict, shift: np.ndarray) -> dict[tuple[int, int, int], np.ndarray]:
    """Sums of t and (x - shift) t with t = ln(1+|r|) over train rows, for each fit by (trial, repeat, fold)."""
    plan, q = design.plan, len(design.sparse)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, np.ndarray] = {}
        for raw in stretches(batches):
            for key, rows, residual in _residuals(Batch(raw, plan), fits, plan):
                t = np.log1p(np.abs(residual))
                part = np.concatenate([[t.sum()], rows.transposed_times(t, shift, q)])
                acc[key] = acc[key] + part if key in acc else part
        if acc:
            named = {n: pa.array([k[i] for k in acc], pa.int32()) for i, n in enumerate(("trial", "repeat", "fold"))}
            named["v"] = pa.array(list(acc.values()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(named)

    parts = design.rows.mapInArrow(sums, "trial int, repeat int, fold int, v array<double>")
    summed = sum_vectors(parts, ["trial", "repeat", "fold"]).toLocalIterator()
    return {(s["trial"], s["repeat"], s["fold"]): np.array(s["v"]) for s in summed}


def _residual_quantiles(design: Design, fits: dict, sizes: dict[tuple[int, int, int], int], q: float) -> dict[tuple[int, int, int], float]:
    """The exact quantile of |residual| over train rows, interpolated, for each fit; no residual is written.

    Numbers from 0 on are ordered as their bits. Each pass counts, per fit and wanted rank, the next 21 bits of the residuals that agree with
    what is known of it so far; tasks send counts of the bit patterns they meet, and three passes give the number itself.
    """
    plan, spark = design.plan, design.rows.sparkSession
    ranks = {(*key, which): int(take((n - 1) * q)) for key, n in sizes.items() for which, take in enumerate((np.floor, np.ceil))}
    known, step = {key: 0 for key in ranks}, QUANTILE_SHIFTS[0] - QUANTILE_SHIFTS[1]
    for shift in QUANTILE_SHIFTS:

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, known: dict = known) -> Iterator[pa.RecordBatch]:
            acc: dict[tuple, Sums] = {}
            for raw in stretches(batches):
                for key, _, residual in _residuals(Batch(raw, plan), fits, plan):
                    bits = np.abs(residual).view(np.int64)
                    for which in (0, 1):
                        head = bits[bits >> (shift + step) == known[(*key, which)]] >> shift
                        value, n = np.unique(head, return_counts=True)
                        acc.setdefault((*key, which), Sums()).add(value, n[:, None])
            for key, sums in acc.items():
                if sums.size:
                    value, n = sums.done()
                    named = {c: pa.array(np.full(len(value), k), pa.int32()) for c, k in zip(("trial", "repeat", "fold", "which"), key)}
                    yield pa.RecordBatch.from_pydict({**named, "head": pa.array(value), "n": pa.array(n[:, 0].astype(np.int64))})

        parts = design.rows.mapInArrow(count, "trial int, repeat int, fold int, which int, head long, n long")
        keys = ["trial", "repeat", "fold", "which"]
        wanted = spark.createDataFrame([(*k, r) for k, r in ranks.items()], "trial int, repeat int, fold int, which int, rank long")
        totals = parts.groupBy(*keys, "head").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("head")) - F.col("n")  # at most 2^21 patterns a rank
        at = totals.withColumn("before", before).join(F.broadcast(wanted), keys)
        hits = at.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).collect()
        known = {tuple(h[k] for k in keys): h["head"] for h in hits}
        ranks = {tuple(h[k] for k in keys): h["rank"] - h["before"] for h in hits}
    value = {key: float(np.array([bits], np.int64).view(float)[0]) for key, bits in known.items()}
    return {k: value[(*k, 0)] + (value[(*k, 1)] - value[(*k, 0)]) * ((n - 1) * q % 1.0) for k, n in sizes.items()}


def _score(design: Design, fits: dict) -> DataFrame:
    """Out-of-fold predictions of every trial: each task applies the few coefficient vectors to its batches."""
    plan = design.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in stretches(batches):
            batch, session = Batch(raw, plan), numbers(raw, "session")
            sides = {}
            for (trial, r, f), fit in fits.items():
                if (r, f) not in sides:
                    mark = batch.side(r, f, valid=True)
                    sides[(r, f)] = mark, batch.rows(mark, r * plan.n_folds + f)
                mark, rows = sides[(r, f)]
                if len(rows):
                    n = len(rows)
                    uncertainty = fit.uncertainty(rows)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "trial": pa.array(np.full(n, trial), pa.int32()),
                            "session": pa.array(session[mark], pa.int64()),
                            "predicted_return": pa.array(fit.predict(rows)),
                            "predicted_uncertainty": pa.array(uncertainty, mask=np.isnan(uncertainty)),
                            "realized_return": pa.array(batch.y[mark]),
                            "repeat": pa.array(np.full(n, r), pa.int32()),
                            "fold": pa.array(np.full(n, f), pa.int32()),
                        }
                    )

    return design.rows.mapInArrow(
        run,
        "trial int, session long, predicted_return double, predicted_uncertainty double, realized_return double, "
        "repeat int, fold int",
    )


def cross_validate(
    trials: Sequence[Trial],
    seen: DataFrame,
    unseen: DataFrame,
    headlines: DataFrame,
    plan: FoldPlan = FoldPlan(),
    fail_fast: bool = False,
) -> Results:
    """Cross-validate all trials over the same folds. A trial that cannot be solved is recorded, not fatal."""
    trials = list(trials)
    errors: dict[str, str] = {}
    elapsed: dict[str, float] = {}
    good = []
    for trial in trials:
        try:
            check_specs(trial.feature_blocks)
            good.append(trial)
        except Exception as error:
            if fail_fast:
                raise
            errors[trial.name] = str(error)

    targets = materialize(build_targets(seen, unseen).where(F.col(TARGET).isNotNull()), "targets")
    folds = materialize(session_folds(targets, plan.n_folds, plan.seed, plan.n_repeats), "folds")
    inputs = Inputs(seen, headlines, targets)
    done: list[tuple[DataFrame, DataFrame]] = []
    waiting = _compatible(good)
    while waiting:
        members = waiting.pop(0)
        try:
            done.append(_validated(members, inputs, folds, plan, errors, elapsed, fail_fast))
        except Exception as error:
            if fail_fast:
                raise
            if len(members) > 1:
                waiting += [[t] for t in members if t.name not in errors]
            else:
                errors.setdefault(members[0].name, str(error))
    if not done:
        raise ValueError(f"No trial could be fitted: {errors}")
    summary, oof = (reduce(DataFrame.unionByName, parts) for parts in zip(*done))
    return Results(summary, oof, errors, {t: seconds for t, seconds in elapsed.items() if t not in errors})


def _compatible(trials: Sequence[Trial]) -> list[list[Trial]]:
    """Trials in lists within which an alias names one block; a list shares its features and moments."""
    lists: list[tuple[dict[str, FeatureSpec], list[Trial]]] = []
    for trial in trials:
        own = {s.resolved_alias: s for s in trial.feature_blocks}
        for specs, members in lists:
            if all(specs.get(alias, spec) == spec for alias, spec in own.items()):
                specs.update(own)
                members.append(trial)
                break
        else:
            lists.append((own, [trial]))
    return [members for _, members in lists]


def _validated(trials: list[Trial], inputs: Inputs, folds: DataFrame, plan: FoldPlan, errors: dict[str, str], elapsed: dict[str, float], fail_fast: bool) -> tuple[DataFrame, DataFrame]:
    """Fold scores and out-of-fold predictions of trials that agree on their aliases."""
    started, solving = time.perf_counter(), {}
    spark, targets = folds.sparkSession, inputs.sessions
    specs = {s.resolved_alias: s for t in trials for s in t.feature_blocks}
    fm = build_feature_matrix(list(specs.values()), inputs)
    design = build_design(fm, targets, folds, plan)
    numbers = {t.name: n for n, t in enumerate(trials)}
    fits, counts = fit_trials(trials, fm, design, design.masks(), numbers, errors, fail_fast, seconds=solving)
    if not fits:
        raise ValueError(f"No trial could be fitted: {errors}")

    oof = materialize(_positions(_named(_score(design, fits), numbers, plan), trials), "oof")
    keys = ["experiment_name", "repeat", "seed", "fold"]
    sizes = folds.groupBy("repeat").agg(F.count(F.lit(1)).alias("n_all"))
    feature_counts = spark.createDataFrame(
        [(trials[t].name, r, f, float(n)) for (t, r, f), n in counts.items()],
        "experiment_name string, repeat int, fold int, feature_count double",
    )
    summary = (
        evaluate.fold_sharpes(oof, keys)
        .join(F.broadcast(sizes), "repeat")
        .join(F.broadcast(feature_counts), ["experiment_name", "repeat", "fold"])
        .withColumn("n_train", F.col("n_all") - F.col("n_valid"))
        .drop("n_all")
    )
    summary = materialize(summary, "summary")
    shared = (time.perf_counter() - started - sum(solving.values())) / len(trials)
    elapsed.update({t: own + shared for t, own in solving.items()})
    return summary, oof


def _named(scored: DataFrame, numbers: dict[str, int], plan: FoldPlan) -> DataFrame:
    """The predictions with experiment names and seeds, written once."""
    rows = [(n, t) for t, n in numbers.items()]
    names = scored.sparkSession.createDataFrame(rows, "trial int, experiment_name string")
    named = scored.join(F.broadcast(names), "trial").withColumn("seed", F.lit(plan.seed) + F.col("repeat"))
    return materialize(named, "predictions")


def _kinds(trials: Sequence[Trial]) -> list[tuple[str, float, float]]:
    return list(dict.fromkeys(k for t in trials for k in t.model.kinds()))


def trial_moments(trials: Sequence[Trial], design: Design) -> tuple[np.ndarray, dict[tuple[int, int, int], Moments]]:
    """The shift and the train moments that all the trials are solved from, in one pass."""
    shift = dense_shift(design)
    return shift, design_moments(design, _kinds(trials), shift)


def fit_trials(trials, fm, design, masks, numbers, errors, fail_fast, known=None, seconds=None) -> tuple[dict[tuple[int, int, int], Fit], dict[tuple[int, int, int], int]]:
    """Solve every trial and cell; returns fits over all columns of the design and feature counts by (trial, repeat, fold).

    `masks` says which columns a cell's train side lacks (they are no features) and its valid side lacks (they count as 0 there).
    `known` are the shift and moments of an earlier call with the same design and kinds; `seconds` takes each trial's time to solve.
    """
    kinds = _kinds(trials)
    shift, moments = known or trial_moments(trials, design)
    place = {c: i for i, c in enumerate(design.columns)}
    p = len(place)
    fits: dict[tuple[int, int, int], Fit] = {}
    chosen: dict[tuple[int, int, int], tuple[list[int], list[int]]] = {}
    narrow: dict[tuple[int, int, int], Fit] = {}
    by_number = {numbers[t.name]: t for t in trials}
    for n, trial in by_number.items():
        own = trial_columns(trial, fm, design)
        started = time.perf_counter()
        try:
            for r, f in design.plan.cells:
                no_train, no_valid = masks[(r, f)]
                columns = [place[c] for c in own if c not in no_train]
                parts = [moments[(kinds.index(k), r, f)].select(columns) for k in trial.model.kinds()]
                fit = trial.model.solve(parts)
                blanked = [place[c] for c in own if c in no_valid]
                narrow[(n, r, f)], chosen[(n, r, f)] = fit, (columns, blanked)
                fits[(n, r, f)] = fit.widened(columns, p, blanked)
        except Exception as error:
            if fail_fast:
                raise
            errors[trial.name] = str(error)
            for key in [k for k in fits if k[0] == n]:
                fits.pop(key)
        if seconds is not None:
            seconds[trial.name] = time.perf_counter() - started
    second = {key: narrow[key].widened(chosen[key][0], p) for key in fits if by_number[key[0]].model.second_pass}
    if second:
        one = kinds.index(ONE)
        sums = _log_sums(design, second, shift)
        sizes = {key: round(moments[(one, *key[1:])].n) for key in second}
        floors = _residual_quantiles(design, second, sizes, 0.1)
        for key in second:
            columns, blanked = chosen[key]
            alpha = float(by_number[key[0]].model.params.get("alpha", STANDARDISED_ALPHA))
            m = moments[(one, *key[1:])].select(columns)
            v = sums[key]
            full = uncertainty_ridge(narrow[key], m, v[0], v[1:][columns], floors[key], alpha)
            fits[key] = full.widened(columns, p, blanked)
    return fits, {key: len(chosen[key][0]) for key in fits}


def _positions(predictions: DataFrame, trials: Sequence[Trial]) -> DataFrame:
    """Size every trial's fold batches; trials with equal sizing parameters go together."""
    scored = predictions.withColumn(
        "score", evaluate.score(F.col("predicted_return"), F.col("predicted_uncertainty"))
    )
    by_sizing: dict[tuple, list[str]] = {}
    for trial in trials:
        by_sizing.setdefault(tuple(sorted(trial.position_sizing.items())), []).append(trial.name)
    out = None
    for sizing, names in by_sizing.items():
        rows = scored if len(by_sizing) == 1 else scored.where(F.col("experiment_name").isin(names))
        sized = evaluate.size_positions(rows, ["experiment_name", "repeat", "fold"], **dict(sizing))
        out = sized if out is None else out.unionByName(sized)
    return out.withColumn("pnl", F.col("target_position") * F.col("realized_return")).select(
        "experiment_name",
        "session",
        "predicted_return",
        "predicted_uncertainty",
        "target_position",
        "realized_return",
        "pnl",
        "repeat",
        "seed",
        "fold",
    )

