"""Fitted blocks and models that can be stored and used in another session.

A fitted model is its columns and what was learned for them: category columns, vocabularies with their weights, coefficients. It is
written as three small tables under one folder and needs no training data to predict.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.plans.blocks import FeatureSpec, Inputs, TextBlock, build_feature_matrix
from tickloom.plans.design import Categories, Design, fitted_rows
from tickloom.plans.experiment import Trial
from tickloom.plans.linear import Fit, Model
from tickloom.plans.product import ALL, FullModel

VERSION = 1
VOCABULARY = "alias string, cell int, slot int, term string, position int, idf double"
COLUMNS = "place int, name string, kind string, coef double, unc_coef double"


def transform(model: FullModel, inputs: Inputs) -> DataFrame:
    """The fitted blocks on other sessions: (session, column, value) for every dense column and every entry that is not absent."""
    fm = build_feature_matrix(model.trial.feature_blocks, inputs)
    rows = fitted_rows(fm.df, fm, model.design)
    dense = F.transform(F.col("x"), lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    first = F.lit(len(model.design.dense))
    sparse = F.zip_with("ks", "vs", lambda k, v: F.struct((first + k).alias("i"), v.alias("v")))
    long = rows.select("session", F.explode(F.concat(dense, sparse)).alias("e"))
    names = F.array(*[F.lit(c) for c in model.design.columns])
    return long.select("session", F.element_at(names, F.col("e.i") + 1).alias("column"), F.col("e.v").alias("value"))


def save(model: FullModel, spark: SparkSession, path: str) -> None:
    """Write the model under `path`; blocks and solvers given as functions are not stored, only their names."""
    design, fit, trial = model.design, model.fit, model.trial
    meta = {
        "version": VERSION,
        "name": trial.name,
        "blocks": [{"name": s.name, "alias": s.alias, "params": s.params, "own": s.build is not None} for s in trial.feature_blocks],
        "model": {"name": trial.model.name, "params": trial.model.params},
        "position_sizing": trial.position_sizing,
        "feature_count": model.feature_count,
        "categories": design.categories.names,
        "category_aliases": design.category_aliases,
        "texts": [{"alias": a, "slots": t.slots, "labels": t.labels, "min_df": t.min_df, "max_features": t.max_features} for a, t in design.texts.items()],
        "fit": {"intercept": fit.intercept, "residual_std": fit.residual_std, "unc_intercept": fit.unc_intercept, "unc_floor": fit.unc_floor},
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    unc = fit.unc_coef if fit.unc_coef is not None else [None] * len(fit.coef)
    kinds = ["dense"] * len(design.dense) + ["sparse"] * len(design.sparse)
    rows = [(i, c, k, float(b), None if u is None else float(u)) for i, (c, k, b, u) in enumerate(zip(design.columns, kinds, fit.coef, unc))]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    terms = spark.createDataFrame([], VOCABULARY)
    for alias, vocab in design.vocabularies.items():
        terms = terms.unionByName(vocab.select(F.lit(alias).alias("alias"), "cell", "slot", "term", "position", "idf"))
    terms.write.mode("overwrite").parquet(f"{path}/vocabulary")


def load(spark: SparkSession, path: str, builds: dict[str, Callable] | None = None) -> FullModel:
    """The model written under `path`; `builds` gives the functions of a caller's own blocks by alias again."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["version"] != VERSION:
        raise ValueError(f"The model was stored as version {meta['version']}; this library reads {VERSION}.")
    specs = []
    for b in meta["blocks"]:
        alias = b["alias"] or b["name"]
        if b["own"] and alias not in (builds or {}):
            raise ValueError(f"Block {alias!r} was built by a function; give it again in `builds`.")
        specs.append(FeatureSpec(b["name"], b["params"], b["alias"], builds[alias] if b["own"] else None))
    columns = spark.read.schema(COLUMNS).parquet(f"{path}/columns").orderBy("place").collect()
    dense, sparse = ([r["name"] for r in columns if r["kind"] == kind] for kind in ("dense", "sparse"))
    terms = spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary")
    texts = {t["alias"]: TextBlock(t["alias"], None, t["slots"], t["labels"], t["min_df"], t["max_features"]) for t in meta["texts"]}
    vocabularies = {a: terms.where(F.col("alias") == a).drop("alias") for a in texts}
    none = [set() for _ in meta["categories"]]
    categories = Categories(meta["categories"], none, none)
    design = Design(None, dense, sparse, ALL, categories, meta["category_aliases"], vocabularies, texts)
    unc = None if meta["fit"]["unc_intercept"] is None else np.array([r["unc_coef"] for r in columns])
    fit = Fit(coef=np.array([r["coef"] for r in columns]), unc_coef=unc, **meta["fit"])
    trial = Trial(meta["name"], tuple(specs), Model(meta["model"]["name"], meta["model"]["params"]), meta["position_sizing"])
    return FullModel(trial, fit, design, meta["feature_count"])
