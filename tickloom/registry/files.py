"""Files that the library writes and reads again: split tables, prediction registry, reports, stored models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import matrix
from tickloom.operators.folds import session_folds
from tickloom.plans import stored
from tickloom.plans.blocks import FeatureSpec, Inputs
from tickloom.plans.experiment import Trial, write_reports
from tickloom.plans.linear import build_model
from tickloom.plans.product import Split, fit_full, prediction_product
from tickloom.registry import common as c
from tickloom.registry import fits
from tickloom.registry import models as model_queries
from tickloom.registry import text as text_queries
from tickloom.registry.common import query, tidy, tidy_sql
from tickloom.session import checkpoint_dir, materialize
from tickloom.sources import sinks, tables

TRAIN = (2, 3, 4)
PARTS = {"train": TRAIN, "public_test": (0,), "private_test": (1,)}


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _parts(folds, frame, keep):
    return matrix.restrict(frame, folds.where(F.col("fold").isin(*keep)))


# --- split files ------------------------------------------------------------------------------

# Headlines of bars from 25 on stand for those of the unseen half.
_SPLIT_FILES = (
    c.TARGETS_HEADLINES
    + model_queries.folds_sql()
    + """,
sp AS (SELECT session, CASE fold WHEN 0 THEN 'public_test' WHEN 1 THEN 'private_test' ELSE 'train' END AS split FROM folds),
f AS (SELECT 'bars' AS kind, CASE WHEN bar_ix < 50 THEN 'seen' ELSE 'unseen' END AS visibility, split, session, close AS v FROM bars JOIN sp USING (session)
      UNION ALL SELECT 'headlines', CASE WHEN bar_ix < 25 THEN 'seen' ELSE 'unseen' END, split, session, pos + length(headline) FROM headlines JOIN sp USING (session)),
q AS (SELECT kind, visibility, split, count(*) AS n_rows, count(DISTINCT session) AS sessions, avg(v) AS mean_value
      FROM f WHERE visibility = 'seen' OR split = 'train' GROUP BY ALL)"""
)


@query("split_files", tidy_sql(_SPLIT_FILES, "kind:s visibility:s split:s n_rows:i sessions:i mean_value", "q"))
def split_files(spark, sf_dir):
    """Bars and headlines of three splits written in the file layout, and read by split, in pairs, and all at once."""
    seen, unseen, headlines = model_queries.inputs(spark, sf_dir)
    headlines = materialize(headlines, "headlines")
    folds = materialize(session_folds(seen), "folds")
    root = _folder(spark, "splits")
    early, late = headlines.where("bar_ix < 25"), headlines.where("bar_ix >= 25")
    for split, keep in PARTS.items():
        tables.save_split(_parts(folds, seen, keep), root, "bars", "seen", split)
        tables.save_split(_parts(folds, early, keep), root, "headlines", "seen", split)
    tables.save_split(_parts(folds, unseen, TRAIN), root, "bars", "unseen", "train")
    tables.save_split(_parts(folds, late, TRAIN), root, "headlines", "unseen", "train")

    train = [t.select(F.lit(v).alias("visibility"), F.lit("train").alias("split"), "session", F.col("close").alias("v")) for v, t in zip(("seen", "unseen"), tables.load_train_bars(spark, root))]
    tests = tables.load_all(spark, root, "bars").where("split <> 'train'").select("visibility", "split", "session", F.col("close").alias("v"))
    bars = train[0].unionByName(train[1]).unionByName(tests).withColumn("kind", F.lit("bars"))
    value = (F.col("pos") + F.length("headline")).cast("double").alias("v")
    news = tables.load_all(spark, root, "headlines").select("visibility", "split", "session", value, F.lit("headlines").alias("kind"))
    out = bars.unionByName(news).groupBy("kind", "visibility", "split")
    return tidy(out.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("session").alias("sessions"), F.avg("v").alias("mean_value")))


# --- registry ---------------------------------------------------------------------------------

_REGISTRY = (
    model_queries._MOMENTUM_POSITION
    + """,
n AS (SELECT CASE fold WHEN 0 THEN 'public_test' ELSE 'private_test' END AS test_split, count(*) AS n_rows FROM pos GROUP BY fold
      UNION ALL SELECT 'combined', count(*) FROM pos),
q AS (SELECT 'momentum' AS model_name, test_split, 1 AS feature_count, 0.25::DOUBLE AS mean_cv_sharpe, 0 AS include_headlines, n_rows AS row_count,
             n_rows AS file_rows, n_rows AS latest_rows, 1 AS stamped, CASE test_split WHEN 'combined' THEN 'both splits' ELSE '' END AS notes FROM n)"""
)


@query(
    "prediction_registry",
    tidy_sql(_REGISTRY, "model_name:s test_split:s feature_count:i mean_cv_sharpe include_headlines:i row_count:i file_rows:i latest_rows:i stamped:i notes:s", "q"),
)
def prediction_registry(spark, sf_dir):
    """Three prediction files with their records in the registry, read back with the rows of each file and of its latest copy."""
    public, private = model_queries._momentum_split(spark, sf_dir)
    folder = _folder(spark, "products")
    both = sinks.combine_splits(public, private)
    for split, rows, notes in (("public_test", public, None), ("private_test", private, None), ("combined", both, "both splits")):
        record = sinks.prediction_metadata("momentum", split, 1, 0.25, notes=notes, row_count=rows.count())
        sinks.save_predictions(rows, f"{folder}/{split}", rows, record, f"{folder}/registry", f"{folder}/latest_{split}")
    stamped = F.col("created_at_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") & (
        F.abs(F.unix_timestamp(F.to_timestamp("created_at_utc")) - F.unix_timestamp(F.current_timestamp())) < 3600
    )
    records = tables.load_registry(spark, f"{folder}/registry").withColumn("stamped", stamped.cast("int"))
    sizes = None
    for split in ("public_test", "private_test", "combined"):
        counts = [tables.load_predictions(spark, f"{folder}/{p}{split}").agg(F.count(F.lit(1)).alias(n)) for p, n in (("", "file_rows"), ("latest_", "latest_rows"))]
        one = counts[0].crossJoin(F.broadcast(counts[1])).withColumn("test_split", F.lit(split))  # one row each
        sizes = one if sizes is None else sizes.unionByName(one)
    out = records.join(F.broadcast(sizes), "test_split").withColumns({"notes": F.coalesce("notes", F.lit("")), "include_headlines": F.col("include_headlines").cast("int")})
    return tidy(out.select("model_name", "test_split", "feature_count", "mean_cv_sharpe", "include_headlines", "row_count", "file_rows", "latest_rows", "stamped", "notes"))


# --- reports ----------------------------------------------------------------------------------

_BOARD = "experiment_name:s config_path:s rank:i mean_cv_sharpe std_cv_sharpe mean_feature_count cv_folds feature_blocks:s model:s status:s timed:i"


def _reports(spark, sf_dir, name: str):
    results, trials = model_queries._small_results(spark, sf_dir)
    folder = _folder(spark, "reports")
    paths = write_reports(results, trials, folder)
    written = [spark.read.csv(p, header=True, inferSchema=True).count() for p in (paths[name], f"{folder}/latest_{name}")]
    if written[0] != written[1]:
        raise ValueError(f"The latest report has {written[1]} rows, the stamped one {written[0]}.")
    return spark.read.csv(f"{folder}/latest_{name}", header=True, inferSchema=True).na.fill("")


@query(
    "leaderboard_report",
    tidy_sql(
        model_queries._SMALL
        + """,
q AS (SELECT row_number() OVER (ORDER BY mean_cv_sharpe DESC, experiment_name) AS rank, *, '' AS config_path, 'price' AS feature_blocks, 'ridge' AS model, 'ok' AS status, 1 AS timed FROM lb
      UNION ALL SELECT NULL, 'unknown', NULL, NULL, NULL, NULL, '', '', '', 'error', 0)""",
        _BOARD,
        "q",
    ),
)
def leaderboard_report(spark, sf_dir):
    """The latest leaderboard file of six ridges and a trial that cannot be built; every fitted trial has its own seconds."""
    board = _reports(spark, sf_dir, "experiment_sweep")
    return tidy(board.withColumn("timed", (F.coalesce("elapsed_seconds", F.lit(0.0)) > 0).cast("int")).drop("error", "elapsed_seconds"))


@query(
    "fold_report",
    tidy_sql(
        model_queries._SMALL
        + """,
q AS (SELECT experiment_name, '' AS config_path, 'price' AS feature_blocks, 'ridge' AS model, 0 AS repeat, 42 AS seed, fold, width AS feature_count, sharpe,
             nv AS n_valid, (SELECT count(*) FROM fr) - nv AS n_train FROM fs JOIN (SELECT fold, count(*) AS nv FROM fx GROUP BY fold) USING (fold))""",
        "experiment_name:s config_path:s feature_blocks:s model:s repeat:i seed:i fold:i feature_count sharpe n_valid:i n_train:i",
        "q",
    ),
)
def fold_report(spark, sf_dir):
    """The latest file of fold scores of the same sweep."""
    return tidy(_reports(spark, sf_dir, "experiment_sweep_folds"))


# --- stored models ----------------------------------------------------------------------------

# Fitted on folds 2 to 4; folds 0 and 1 are the valid sides of two cells.
_STORED_CELLS = model_queries.folds_sql() + """,
zc AS (SELECT g, 0 AS repeat, 42 AS seed, fold, session, fold < 2 AS valid, target_return AS y
       FROM folds JOIN targets USING (session) CROSS JOIN range(2) AS r(g) WHERE fold >= 2 OR fold = g)"""
_NUMERIC = ["seen_return_open_to_close", "max_drawdown"]
_STORED_ITEMS = """SELECT g, session, i, v FROM zc JOIN fl USING (session) UNION ALL SELECT g, session, i + 2, v FROM tw
  UNION ALL SELECT g, session, i + 2 + w, v FROM cw JOIN (SELECT g, count(*) AS w FROM vocab GROUP BY g) USING (g)"""
_STORED_SQL = fits.recursive(
    c.BARS + fits._PRICE + fits._TARGET + "," + c._HEADLINE_ROWS + ",",
    text_queries._COMPANY,
    text_queries._DOCS,
    ",\nsd AS (SELECT 0 AS slot, session, text FROM sdoc)",
    _STORED_CELLS,
    fits._CATEGORY_ITEMS,
    fits.text_sql("sd", 24),
    fits.plain_sql(_NUMERIC, "price", "fl"),
    fits.fit_sql(_STORED_ITEMS, "linear", 2000.0),
)


def _stored(spark, sf_dir):
    """A model over two price features, categories and terms: fitted, written, and read again; with the splits to predict."""
    seen, unseen, headlines = model_queries.inputs(spark, sf_dir)
    headlines = materialize(headlines, "headlines")
    folds = materialize(session_folds(seen), "folds")
    blocks = (FeatureSpec("price"), FeatureSpec("headline_parser"), FeatureSpec("headline_tfidf", {"max_features": 24}, "tf"))
    wanted = {f"price__{x}" for x in _NUMERIC}
    keep = lambda name: name in wanted or name.startswith("tf__") or fits.is_category(name)
    trial = Trial("stored", blocks, build_model("linear"), columns=keep)
    model = fit_full(trial, *[_parts(folds, t, TRAIN) for t in (seen, unseen, headlines)])
    path = _folder(spark, "model")
    stored.save(model, spark, path)
    splits = [Split(n, _parts(folds, seen, PARTS[n]), _parts(folds, headlines, PARTS[n])) for n in ("public_test", "private_test")]
    return stored.load(spark, path), splits


@query("stored_model_product", tidy_sql(_STORED_SQL, "session:i target_position", "oof"))
def stored_model_product(spark, sf_dir):
    """Both test splits predicted by a model that was written and read again."""
    model, splits = _stored(spark, sf_dir)
    return tidy(prediction_product(model, *splits))


@query(
    "stored_block_transform",
    tidy_sql(
        fits.recursive(
            c.BARS + fits._PRICE + fits._TARGET + "," + c._HEADLINE_ROWS + ",",
            text_queries._EVENTS,
            text_queries._DOCS,
            ",\nsd AS (SELECT 0 AS slot, session, text FROM sdoc)",
            _STORED_CELLS,
            fits.text_sql("sd", 24),
            """,
q AS (SELECT session, 'tf__session_text__' || lpad(i::VARCHAR, 3, '0') AS "column", v AS value FROM tw WHERE g = 0 AND v <> 0
        AND session IN (SELECT session FROM zc WHERE g = 0 AND valid)
      UNION ALL SELECT session, 'price__max_drawdown', max_drawdown FROM price WHERE session IN (SELECT session FROM zc WHERE g = 0 AND valid))""",
        ),
        "session:i column:s value",
        "q",
    ),
)
def stored_block_transform(spark, sf_dir):
    """The stored blocks applied to the public split: term weights under the train vocabulary, and one price column."""
    model, (public, _) = _stored(spark, sf_dir)
    values = stored.transform(model, Inputs(public.bars, public.headlines, public.sessions))
    return tidy(values.where("column LIKE 'tf\\\\_\\\\_%' OR column = 'price__max_drawdown'"))
