import json
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.text import document_text
from tickloom.operators import companies, documents, tfidf
from tickloom.operators.folds import session_folds
from tickloom.operators.profile import normal_quantile
from tickloom.operators.targets import build_targets
from tickloom.plans import design, evaluate, forest, stored
from tickloom.plans.blocks import FeatureSpec, Inputs, TextBlock, bar_features, build_feature_matrix
from tickloom.plans.experiment import FoldPlan, Trial, cross_validate, trial_grid
from tickloom.plans.linear import Model, build_model, max_sharpe, position_sharpe, raw_ridge, standardised_ridge, weighted_ridge
from tickloom.plans.moments import ONE, Y_SQUARED, abs_power, collect_moments
from tickloom.plans.product import Split, fit_full, predict, predict_splits, run_product
from tickloom.plans.selection import forward_select
from tickloom.plans.sweep import cv_sweep, holdout_sweep, linear_scores
from tickloom.registry import common
from tickloom.session import materialize
from tickloom.sources import adapters, sinks
from tickloom.sources.tables import load_predictions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """Sixty sessions: ticks of the smallest table regrouped, so that folds have some rows."""
    rows = common.lineitem(spark, SF).withColumn("l_suppkey", F.col("l_orderkey") % 60)
    placed = adapters.ticks(rows)
    bars = materialize(adapters.bars_from_ticks(placed))
    # Few ticks per session give fewer than a hundred bars; the middle one splits them.
    last = bars.groupBy("session").agg(F.max("bar_ix").alias("m"))
    bars = bars.join(last, "session")
    seen = materialize(bars.where(F.col("bar_ix") <= F.col("m") / 2).drop("m"))
    unseen = materialize(bars.where(F.col("bar_ix") > F.col("m") / 2).drop("m"))
    headlines = materialize(adapters.headlines_from_ticks(placed).where(F.col("bar_ix") <= 45))
    return seen, unseen, headlines


# --- linear models against direct solves ----------------------------------------------------


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(5e4, 3, 200), rng.normal(size=200), rng.normal(size=200)])
    y = 0.3 * x[:, 1] - 0.1 * x[:, 2] + rng.normal(size=200)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, cell=0)
    got = collect_moments(
        spark.createDataFrame(pdf).repartition(3), ["a", "b", "c"], "y", ["cell"], [ONE, abs_power(0.5, 0.25), Y_SQUARED]
    )
    return x, y, [got[(k, 0, 0)] for k in range(3)]


def test_standardised_ridge(regression):
    x, y, (m, _, _) = regression
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z + 20 * np.eye(3), z.T @ (y - y.mean()))
    fit = standardised_ridge(m, 20.0)
    assert fit.predict(x) == pytest.approx(y.mean() + z @ b, abs=1e-8)
    assert fit.residual_std == pytest.approx((y - y.mean() - z @ b).std(ddof=1))


@pytest.mark.parametrize("weighted", [False, True])
def test_raw_and_weighted_ridge(regression, weighted):
    x, y, (m, mw, _) = regression
    w = np.maximum(np.abs(y) ** 0.5, 0.25) if weighted else np.ones_like(y)
    w = w / w.mean()
    d = np.column_stack([np.ones(200), x - x.mean(0)])
    c = np.linalg.solve(d.T @ (d * w[:, None]) + 10 * np.diag([0, 1, 1, 1]), d.T @ (w * y))
    fit = weighted_ridge(mw, 10.0) if weighted else raw_ridge(m, 10.0)
    assert fit.predict(x) == pytest.approx(d @ c, abs=1e-8)
    r = y - d @ c
    want = np.sqrt(np.average((r - np.average(r, weights=w)) ** 2, weights=w)) if weighted else r.std(ddof=1)
    assert fit.residual_std == pytest.approx(want)


def test_max_sharpe_beats_perturbations(regression):
    x, y, (m, _, y2) = regression
    fit = max_sharpe(m, y2)

    def sharpe(position):
        return (position * y).mean() / (position * y).std() * 16

    best = sharpe(fit.predict(x))
    assert best == pytest.approx(position_sharpe(fit, m, y2), rel=1e-6)
    z = np.column_stack([np.ones(200), (x - x.mean(0)) / x.std(0)])
    w = np.linalg.lstsq(z, fit.predict(x), rcond=None)[0]
    rng = np.random.default_rng(0)
    assert all(sharpe(z @ (w + rng.normal(0, 0.1 * np.abs(w).max(), 4))) <= best + 1e-9 for _ in range(200))


def test_singular_without_penalty_fails_clearly(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0], "k": 7.0, "y": [1.0, 2.0, 2.0, 4.0], "cell": 0})
    got = collect_moments(spark.createDataFrame(pdf), ["a", "k"], "y", ["cell"])
    with pytest.raises(ValueError, match="singular"):
        raw_ridge(got[(0, 0, 0)], 0.0)
    assert np.isfinite(raw_ridge(got[(0, 0, 0)], 1.0).coef).all()
    with pytest.raises(ValueError):
        build_model("nope")


# --- sizing ---------------------------------------------------------------------------------


def test_sizing_edges(spark):
    rows = [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 1.0), (1, 1, -1.0), (1, 2, 500.0), (1, 3, None)]
    df = spark.createDataFrame(rows, "fold int, session int, score double")
    got = evaluate.size_positions(df, ["fold"], percentile=50.0).orderBy("fold", "session").collect()
    assert [r["target_position"] for r in got] == [0.0, 0.0, 100.0, -100.0, 100.0, None]


# --- cross-validation against brute force ---------------------------------------------------


def tfidf_by_hand(train, texts, min_df, cap):
    def terms(t):
        w = t.split()
        return w + ["_".join(p) for p in zip(w, w[1:])]

    df, tf = Counter(), Counter()
    for s in train:
        t = terms(texts.get(s, ""))
        tf.update(t)
        df.update(set(t))
    vocab = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-tf[t], -df[t], t))[:cap]
    idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in vocab}

    def row(s):
        c = Counter(t for t in terms(texts.get(s, "")) if t in idf)
        v = np.array([c[t] * idf[t] for t in vocab])
        n = np.linalg.norm(v)
        return v / n if n else v

    return row


def solve_by_hand(name, x, y, params):
    """Returns predict and uncertainty functions."""
    if name == "linear":
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-6, scale, 1.0)
        z = (x - mean) / scale

        def ridge(t):
            return t.mean(), np.linalg.solve(z.T @ z + 2000 * np.eye(z.shape[1]), z.T @ (t - t.mean()))

        b0, b = ridge(y)
        r = np.abs(y - b0 - z @ b)
        u0, u = ridge(np.log1p(r))
        floor = max(np.quantile(r, 0.1), 1e-6)
        return (
            lambda v: b0 + (v - mean) / scale @ b,
            lambda v: np.maximum(np.expm1(u0 + (v - mean) / scale @ u), floor),
        )
    w = np.ones_like(y)
    if name == "weighted_ridge":
        w = np.maximum(np.abs(y) ** params["weight_power"], params["min_weight"])
        w = w / w.mean()
    d = np.column_stack([np.ones(len(y)), x])
    p = params["alpha"] * np.eye(d.shape[1])
    p[0, 0] = 0
    c = np.linalg.solve(d.T @ (d * w[:, None]) + p, d.T @ (w * y))
    r = y - d @ c
    std = r.std(ddof=1) if name == "ridge" else np.sqrt(np.average((r - np.average(r, weights=w)) ** 2, weights=w))
    return (lambda v: c[0] + v @ c[1:]), (lambda v: np.full(len(v), max(std, 1e-6)))


MODELS = {
    "linear": build_model("linear"),
    "ridge": build_model("ridge", {"alpha": 10.0}),
    "weighted": build_model("weighted_ridge", {"alpha": 10.0, "weight_power": 0.5, "min_weight": 0.25}),
}
TEXT = FeatureSpec("headline_tfidf", {"max_features": 12, "text_source": "body"}, "tf")


def test_cross_validation_matches_brute_force(spark, inputs):
    """Categories with per-side thresholds, fold vocabularies, three models, sizing: everything at once."""
    seen, unseen, headlines = inputs
    plan = FoldPlan(n_folds=3, n_repeats=2)
    features = {
        "seq": [FeatureSpec("price"), FeatureSpec("headline_sequence")],
        "news": [FeatureSpec("price"), FeatureSpec("headline_parser")],
        "text": [FeatureSpec("price"), FeatureSpec("headline_parser"), TEXT],
    }
    trials = trial_grid("t", features, MODELS)
    cv = cross_validate(trials, seen, unseen, headlines, plan, fail_fast=True)
    oof = cv.oof.toPandas()
    counts = cv.folds.toPandas().set_index(["experiment_name", "repeat", "fold"])["feature_count"]

    y = build_targets(seen, unseen).toPandas().set_index("session")["target_return"].sort_index()
    i = Inputs(seen, headlines, build_targets(seen, unseen))
    fm = build_feature_matrix([FeatureSpec("price"), FeatureSpec("headline_sequence"), FeatureSpec("headline_parser")], i)
    x = fm.df.toPandas().set_index("session").loc[y.index]
    sums = i.news.category_sums.toPandas().pivot(index="session", columns="column", values="value").fillna(0.0)
    category_of = {f"headline_parser__w_{c}": c for c in sums.columns}
    x = x.join(sums.rename(columns={c: name for name, c in category_of.items()})).fillna(0.0)
    blocks = {**fm.columns, "headline_parser": [*fm.columns["headline_parser"], *category_of]}
    cats = companies.category_counts(i.news.parsed, ["session"]).toPandas()
    parts = documents.document_parts(i.news.parsed, ["session"], document_text("body"))
    import re

    texts = {r["session"]: " ".join(re.findall("[a-z0-9]+", r["text"])) for r in parts.collect()}
    folds = session_folds(build_targets(seen, unseen), 3, 42, 2).toPandas()

    checked = 0
    for (repeat, fold), g in folds.groupby(["repeat", "fold"]):
        valid = sorted(g["session"])
        train = sorted(set(y.index) - set(valid))

        def kept(side):
            total = cats[cats.session.isin(side)].groupby("column").agg(v=("value", "sum"), m=("min_total", "max"))
            return set(total.index[total.v >= total.m])

        in_train, in_valid = kept(train), kept(valid)
        row = tfidf_by_hand(train, texts, 2, 12)
        for f, specs in features.items():
            cols = [c for s in specs for c in blocks.get(s.resolved_alias, [])]
            cols = [c for c in cols if c not in category_of or category_of[c] in in_train]
            a, b = x.loc[train, cols].to_numpy(), x.loc[valid, cols].to_numpy().copy()
            for j, c in enumerate(cols):
                if c in category_of and category_of[c] not in in_valid:
                    b[:, j] = 0.0
            if f == "text":
                a = np.column_stack([a, [row(s) for s in train]])
                b = np.column_stack([b, [row(s) for s in valid]])
            for m, model in MODELS.items():
                predict_, uncertainty = solve_by_hand(model.name, a, y.loc[train].to_numpy(), model.params)
                p, u = predict_(b), uncertainty(b)
                score = p / np.maximum(np.abs(u), 1e-6)
                position = np.clip(score / np.percentile(np.abs(score), 90), -1, 1) * 100
                name = f"t__{f}__{m}"
                got = oof[(oof.experiment_name == name) & (oof.repeat == repeat) & (oof.fold == fold)].set_index("session").loc[valid]
                assert got["predicted_return"].to_numpy() == pytest.approx(p, rel=2e-4, abs=1e-6), (name, repeat, fold)
                assert got["predicted_uncertainty"].to_numpy() == pytest.approx(u, rel=2e-4, abs=1e-6)
                assert got["target_position"].to_numpy() == pytest.approx(position, rel=1e-3, abs=1e-2)
                assert counts[(name, repeat, fold)] == a.shape[1]
                checked += 1
    assert checked == 54
    averaged = evaluate.average_repeats(cv.oof.where(F.col("experiment_name") == "t__seq__ridge")).toPandas()
    assert (averaged["cv_prediction_count"] == 2).all() and len(averaged) == len(y)


def test_failed_trials_are_recorded(spark, inputs):
    trials = [
        Trial("good", (FeatureSpec("price"),), build_model("ridge", {"alpha": 1.0})),
        Trial("twice", (FeatureSpec("price"), FeatureSpec("price")), build_model("linear")),
        Trial("unknown", (FeatureSpec("nope"),), build_model("linear")),
    ]
    cv = cross_validate(trials, *inputs, FoldPlan(n_folds=3))
    board = cv.leaderboard(trials).collect()
    assert [r["status"] for r in board] == ["ok", "error", "error"] and board[0]["rank"] == 1
    with pytest.raises(ValueError):
        cross_validate(trials, *inputs, FoldPlan(n_folds=3), fail_fast=True)


def test_one_alias_may_mean_two_blocks(spark, inputs):
    """Trials that disagree on an alias are validated apart; the rest of the sweep is as without them."""
    model = build_model("ridge", {"alpha": 10.0})
    text = [FeatureSpec("headline_tfidf", {"min_df": n, "max_features": 8}) for n in (1, 3)]
    trials = [Trial(f"t{n}", (FeatureSpec("price"), t), model) for n, t in enumerate(text)]
    trials.append(Trial("plain", (FeatureSpec("price"),), model))
    plan = FoldPlan(n_folds=3)
    both = cross_validate(trials, *inputs, plan).folds.toPandas().set_index(["experiment_name", "fold"])["sharpe"]
    assert len(both) == 9
    alone = cross_validate(trials[1:2], *inputs, plan).folds.toPandas().set_index(["experiment_name", "fold"])["sharpe"]
    assert both.loc[alone.index].to_numpy() == pytest.approx(alone.to_numpy())


def test_callers_blocks_and_models(spark, inputs):
    def ranges(bars):
        return bars.groupBy("session").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))

    def broken(bars):
        raise RuntimeError("no such column")

    def mean_only(params, moments):
        fit = raw_ridge(moments, 1e12)
        return fit

    trials = [
        Trial("own", (bar_features("ranges", ranges),), Model("mine", solver=mean_only)),
        Trial("broken", (bar_features("broken", broken),), build_model("ridge")),
        Trial("unsolved", (FeatureSpec("price"),), Model("fails", solver=lambda p, m: 1 / 0)),
    ]
    cv = cross_validate(trials, *inputs, FoldPlan(n_folds=3))
    assert {r["experiment_name"] for r in cv.folds.collect()} == {"own"}
    assert set(cv.errors) == {"broken", "unsolved"} and "no such column" in cv.errors["broken"]
    assert {r["feature_count"] for r in cv.folds.collect()} == {2.0}
    with pytest.raises(RuntimeError):
        cross_validate(trials[1:], *inputs, FoldPlan(n_folds=3), fail_fast=True)


def test_forward_selection_over_text_and_categories(spark, inputs):
    """A candidate's score is that of a trial with its columns, whatever block they come from."""
    specs = (FeatureSpec("headline_parser"), FeatureSpec("headline_tfidf", {"max_features": 6}, "tf"))
    model, plan = build_model("ridge", {"alpha": 10.0}), FoldPlan(n_folds=3)
    steps = forward_select(*inputs, specs, model, 3, plan).collect()
    chosen = [r["feature"] for r in steps]
    assert len(set(chosen)) == 3
    trials = [Trial(f"step{n}", specs, model, columns=tuple(chosen[:n])) for n in (1, 2, 3)]
    trials.append(Trial("text", specs, model, columns=("tf__session_text__002",)))
    trials.append(Trial("category", specs, model, columns=("headline_parser__w_topic__ai",)))
    cv = cross_validate(trials, *inputs, plan)
    means = cv.folds.groupBy("experiment_name").agg(F.avg("sharpe").alias("m")).toPandas().set_index("experiment_name")["m"]
    for n, r in enumerate(steps, 1):
        assert means[f"step{n}"] == pytest.approx(r["mean_cv_sharpe"])
    assert means.drop(["step2", "step3"]).max() == means["step1"]


def test_open_vocabulary_of_verbs(spark, inputs):
    """A hundred thousand distinct verbs: rare ones stay in Spark, the others are columns of the fit."""
    seen, unseen, _ = inputs
    n = 100_000
    verb = F.when(F.col("id") % 2 == 0, F.concat(F.lit("verb"), F.col("id"))).otherwise(F.concat(F.lit("often"), F.col("id") % 301))
    rows = spark.range(2 * n).select((F.col("id") % 60).alias("session"), (F.col("id") % 40).cast("int").alias("bar_ix"), "id", F.concat(F.lit("Relbos Corp "), verb, F.lit(" something")).alias("headline"))
    headlines = materialize(rows.withColumn("pos", F.col("id")).drop("id"))
    trial = Trial("verbs", (FeatureSpec("headline_parser"),), build_model("ridge", {"alpha": 10.0}))
    cv = cross_validate([trial], seen, unseen, headlines, FoldPlan(n_folds=3), fail_fast=True)
    model = fit_full(trial, seen, unseen, headlines)
    assert model.design.sparse == sorted(f"headline_parser__w_verb__often{i}" for i in range(301))
    assert {r["feature_count"] for r in cv.folds.collect()} == {len(model.design.dense) + 301.0}


def test_leaderboard_ends_and_winners(spark):
    board = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", None, 1.0), ("d", 2.0, None)], "experiment_name string, m double, k double")
    got = [(r["end"], r["place"], r["experiment_name"]) for r in evaluate.board_ends(board, "m", 2).collect()]
    assert sorted(got) == [("head", 1, "b"), ("head", 2, "d"), ("tail", 1, "a"), ("tail", 2, "d")]
    assert {r["metric"]: r["experiment_name"] for r in evaluate.best_by_metric(board, ["m", "k"]).collect()} == {"m": "b", "k": "a"}


def test_normal_quantile_equals_the_inverse(spark):
    from statistics import NormalDist

    p = [1e-300, 1e-20, 1e-5, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-12]
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("q")).collect()
    assert all(r.q == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-15) for r in rows)


def test_fold_vocabulary_is_cut_as_if_every_term_met_every_fold(spark):
    """Terms are held back from the folds only if they cannot be among a fold's best; ties at the cut included."""
    rng = np.random.default_rng(12)
    rows = [(0, int(s), f"t{t:03d}", int(n)) for s in range(30) for t, n in zip(rng.choice(200, 40, replace=False), rng.integers(1, 4, 40))]
    counts = spark.createDataFrame(rows, "slot int, session long, term string, n long")
    plan = FoldPlan(n_folds=4, n_repeats=2)
    folds = session_folds(spark.range(30).withColumnRenamed("id", "session"), 4, 42, 2)
    fold_of = {(r["repeat"], r["session"]): r["fold"] for r in folds.collect()}
    text = TextBlock("tf", counts, 1, ["session_text"], 2, 12)
    got = {}
    for r in design.fold_vocabulary(text, folds, plan).collect():
        got.setdefault(r["cell"], {})[r["position"]] = (r["term"], r["df"], r["tf"])
    for cell, (repeat, fold) in enumerate(plan.cells):
        df, tf = Counter(), Counter()
        for _, s, t, n in rows:
            if fold_of[(repeat, s)] != fold:
                df[t] += 1
                tf[t] += n
        best = sorted((t for t in df if df[t] >= 2), key=lambda t: (-tf[t], -df[t], t))[:12]
        assert [got[cell][i + 1] for i in range(12)] == [(t, df[t], tf[t]) for t in best] and len(got[cell]) == 12


def test_forest_follows_a_step(spark):
    """A target that steps at one feature's middle: every tree splits there first, and the prediction is the step."""
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(session=range(400), y=np.where(x[:, 1] > 0.5, 2.0, -1.0))
    rows = spark.createDataFrame(pdf)
    model = forest.grow(rows, ["a", "b", "c"], "y", trees=4, depth=2, seed=1)
    assert {(s[0], s[2]) for s in model.splits if s[1] == 1} == {(t, 1) for t in range(4)}
    assert dict(model.importances())["b"] > 0.95
    got = forest.predict(rows, model, ["session", "y"]).toPandas()
    assert ((got["prediction"] - got["y"]).abs() < 0.2).mean() > 0.9
    nulls = spark.createDataFrame([(1, None, 1.0), (2, 5.0, None), (None, 2.0, 3.0)], "session long, a double, y double")
    flat = forest.grow(nulls, ["a"], "y", trees=3, depth=2)
    assert len(forest.predict(nulls, flat, ["session"]).collect()) == 3


def test_top_terms_of_a_large_vocabulary(spark):
    stats = spark.range(5000).select(F.lit(0).alias("slot"), F.concat(F.lit("t"), "id").alias("term"), (F.col("id") % 7 + 1).alias("df"), (F.col("id") % 501).alias("tf"))
    got = tfidf.cut_vocabulary(stats, ["slot"], 2, 1500).collect()
    rows = [r for r in stats.collect() if r.df >= 2]
    want = sorted(rows, key=lambda r: (-r.tf, -r.df, r.term))[:1500]
    assert [r.term for r in sorted(got, key=lambda r: r.position)] == [r.term for r in want]


def test_position_sweep_agrees_with_scored_rows(spark, inputs):
    seen, unseen, _ = inputs
    models = {"s": build_model("max_sharpe", {"penalty": 0.1}), "r": build_model("ridge", {"alpha": 5.0})}
    table = holdout_sweep(seen, unseen, models).toPandas().set_index("model")
    assert set(table["rank"]) == {1, 2}
    from tickloom.operators.price import LEGACY_COLUMNS
    from tickloom.plans.sweep import fit_positions, legacy_design

    design = materialize(legacy_design(seen, unseen))
    rows = design.join(session_folds(design), "session")
    fit = fit_positions(rows.where("fold > 0"), LEGACY_COLUMNS, models["s"])
    scored = linear_scores(rows.where("fold = 0"), LEGACY_COLUMNS, fit).join(design.select("session", "target_return"), "session")
    pnl = scored.selectExpr("target_position * target_return AS p").toPandas()["p"]
    assert table.loc["s", "val_sharpe"] == pytest.approx(pnl.mean() / pnl.std(ddof=0) * 16, rel=1e-5)
    assert cv_sweep(seen, unseen, models).count() == 2


def test_forward_selection_improves_first_step(spark, inputs):
    seen, unseen, headlines = inputs
    model = build_model("ridge", {"alpha": 10.0})
    steps = forward_select(seen, unseen, headlines, [FeatureSpec("price")], model, 2, FoldPlan(n_folds=3)).collect()
    assert [r["step"] for r in steps] == [1, 2] and steps[0]["feature"] != steps[1]["feature"]
    one = [Trial(c, (FeatureSpec("price"),), model, columns=(c,)) for c in (steps[0]["feature"], "price__close_std")]
    cv = cross_validate(one, seen, unseen, headlines, FoldPlan(n_folds=3))
    means = cv.folds.groupBy("experiment_name").agg(F.avg("sharpe").alias("m")).toPandas().set_index("experiment_name")["m"]
    assert means[steps[0]["feature"]] == pytest.approx(steps[0]["mean_cv_sharpe"]) and means.max() == means[steps[0]["feature"]]


# --- product and sinks ----------------------------------------------------------------------


def test_full_model_and_product(spark, inputs, tmp_path):
    seen, unseen, headlines = inputs
    trial = Trial("prod", (FeatureSpec("price"), FeatureSpec("headline_parser"), TEXT), build_model("ridge", {"alpha": 10.0}))
    part = {k: (F.col("session") % 3 == k) for k in range(3)}
    train = [d.where(part[0]) for d in (seen, unseen, headlines)]
    splits = [Split(n, seen.where(part[k]), headlines.where(part[k])) for n, k in (("public_test", 1), ("private_test", 2))]
    model = fit_full(trial, *train)
    own = predict(model, train[0], train[2], train[0].selectExpr("session", "0 AS batch").distinct()).toPandas()
    assert np.isfinite(own["predicted_return"]).all() and own["target_position"].abs().max() == pytest.approx(100.0)
    paths = run_product(trial, *train, *splits, str(tmp_path), FoldPlan(n_folds=3))
    combined = load_predictions(spark, paths["combined"])
    want = seen.where(~part[0]).select("session").distinct().count()
    assert combined.count() == want == combined.select("session").distinct().count()
    # Each split is sized and thresholded by itself, whether predicted alone or together.
    alone = predict(model, splits[1].bars, splits[1].headlines, splits[1].sessions.withColumn("batch", F.lit(3))).toPandas()
    both = combined.toPandas().set_index("session")["target_position"]
    assert alone["target_position"].to_numpy() == pytest.approx(both.loc[alone["session"]].to_numpy(), rel=1e-5)
    lines = [json.loads(line) for f in Path(tmp_path, "registry").glob("*.txt") for line in f.read_text().splitlines()]
    assert {x["test_split"] for x in lines} == {"public_test", "private_test", "combined"}
    assert all(x["feature_count"] == model.feature_count for x in lines)
    assert load_predictions(spark, f"{tmp_path}/latest_combined").count() == want


def test_stored_model_predicts_the_same_rows(spark, inputs, tmp_path):
    """Written in one session, read in another one that has seen no training table."""
    seen, unseen, headlines = inputs
    blocks = (FeatureSpec("price"), FeatureSpec("headline_parser"), TEXT, FeatureSpec("headline_company_tfidf", {"max_features": 5, "include_numeric": True}))
    trial = Trial("kept", blocks, build_model("linear"), {"percentile": 80.0})
    part = {k: (F.col("session") % 3 == k) for k in range(3)}
    model = fit_full(trial, *[d.where(part[0]) for d in inputs])
    split = Split("public_test", seen.where(part[1]), headlines.where(part[1]))
    stored.save(model, spark, f"{tmp_path}/model")
    again = stored.load(spark.newSession(), f"{tmp_path}/model")
    assert again.design.columns == model.design.columns and (again.fit.coef == model.fit.coef).all() and (again.fit.unc_coef == model.fit.unc_coef).all()
    want, got = (predict_splits(m, [split])["public_test"].toPandas() for m in (model, again))
    assert got.equals(want)
    mine, theirs = (Counter(map(tuple, stored.transform(m, Inputs(split.bars, split.headlines, split.sessions)).collect())) for m in (model, again))
    assert mine == theirs and any(c[1].startswith("headline_company_tfidf__w_") for c in mine)


def test_stored_callers_blocks(spark, inputs, tmp_path):
    ranges = lambda bars: bars.groupBy("session").agg(F.max("high").alias("top"))
    block = bar_features("ranges", ranges)
    model = fit_full(Trial("own", (block,), build_model("ridge")), *inputs)
    stored.save(model, spark, f"{tmp_path}/own")
    with pytest.raises(ValueError, match="ranges"):
        stored.load(spark, f"{tmp_path}/own")
    again = stored.load(spark, f"{tmp_path}/own", {"ranges": block.build})
    assert again.design.dense == ["ranges__top"] and again.fit.coef == pytest.approx(model.fit.coef)


def test_splits_may_share_session_ids(spark, inputs):
    seen, unseen, headlines = inputs
    trial = Trial("prod", (FeatureSpec("price"),), build_model("ridge", {"alpha": 10.0}))
    part = {k: (F.col("session") % 3 == k) for k in range(3)}
    model = fit_full(trial, *[d.where(part[0]) for d in inputs])
    one = Split("one", seen.where(part[1]), headlines.where(part[1]))
    renamed = [d.where(part[2]).withColumn("session", F.col("session") - 1) for d in (seen, headlines)]
    two = Split("two", *renamed)
    together = predict_splits(model, [one, two])
    for split in (one, two):
        alone = predict_splits(model, [split])[split.name]
        assert Counter(map(tuple, together[split.name].collect())) == Counter(map(tuple, alone.collect()))


def test_prediction_validation(spark):
    good = spark.createDataFrame([(2, 1.0), (1, -1.0)], "session long, target_position double")
    expected = spark.createDataFrame([(1,), (2,)], "session long")
    assert sinks.validate_predictions(good, expected) is good
    assert [r["session"] for r in sinks.shape_predictions(good).collect()] == [1, 2]
    with pytest.raises(ValueError, match="lack"):
        sinks.validate_predictions(good.drop("target_position"))
    with pytest.raises(ValueError, match="repeat"):
        sinks.validate_predictions(good.union(good))
    for other in ([(1,)], [(1,), (2,), (3,)]):
        with pytest.raises(ValueError, match="match"):
            sinks.validate_predictions(good, spark.createDataFrame(other, "session long"))


def test_only_what_the_blocks_read_is_parsed(spark):
    heads = spark.createDataFrame([(1, 0, 1, "Relbos wins industry award"), (1, 1, 2, "Relbos delays product launch")], "session long, bar_ix int, pos long, headline string")
    bars = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0, 1.0)], "session long, bar_ix int, open double, high double, low double, close double")
    inputs = Inputs(bars, heads, bars.select("session"))
    fm = build_feature_matrix([FeatureSpec("headline_tfidf", {"min_df": 1}, "tf")], inputs)
    assert set(inputs.news.parsed.columns) == {"session", "pos", "body"}
    assert "wins_industry" in {r["term"] for r in fm.texts["tf"].counts.collect()}
    build_feature_matrix([FeatureSpec("headline_sequence")], inputs)  # reads more: all is parsed again
    assert {"polarity", "event_text_normalized"} <= set(inputs.news.parsed.columns)
    inputs = Inputs(bars, heads, bars.select("session"))
    build_feature_matrix([FeatureSpec("headline_parser")], inputs)
    assert "polarity" in inputs.news.parsed.columns and "headline_normalized" not in inputs.news.parsed.columns
