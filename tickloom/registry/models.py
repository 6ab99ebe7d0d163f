"""Queries over matrices, folds, models, evaluation, experiments and prediction products."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tickloom.functions.numeric import moments_corr
from tickloom.operators import matrix, price, reaction, sequence, summary, targets
from tickloom.operators.folds import holdout_split, session_folds
from tickloom.plans import evaluate, sweep
from tickloom.plans.blocks import FeatureSpec, Inputs, build_feature_matrix, headline_features
from tickloom.plans.experiment import FoldPlan, Trial, cross_validate, trial_grid, trial_table
from tickloom.plans.linear import build_model, max_sharpe, position_sharpe, raw_ridge, standard_scale, weighted_ridge
from tickloom.plans.moments import ONE, Y_SQUARED, abs_power, collect_moments
from tickloom.plans.product import Split, fit_full, prediction_product
from tickloom.plans.selection import forward_select
from tickloom.plans.vectors_map import DEFAULT_BLOCKS, RELEVANCE_SUMMARY, VectorBlock, vector_feature_map
from tickloom.registry import bars as bar_queries
from tickloom.registry import common as c
from tickloom.registry import text as text_queries
from tickloom.registry.common import query, tidy, tidy_sql
from tickloom.session import checkpoint_dir, materialize
from tickloom.sources import adapters, sinks
from tickloom.sources.tables import load_predictions

D = "session:i"

# --- SQL fragments --------------------------------------------------------------------------

_PRICE_PART = bar_queries._PRICE[len(c.BARS):].replace("\nq AS (", "\nprice AS (")
_TARGET_PART = c.TARGETS[len(c.BARS):]


def folds_sql(repeats: int = 1, k: int = 5, seed: int = 42) -> str:
    return f""",
folds AS (
  SELECT session, repeat, {seed} + repeat AS seed,
         ntile({k}) OVER (PARTITION BY repeat ORDER BY md5(CAST(session AS VARCHAR) || ':' || CAST({seed} + repeat AS VARCHAR)), session) - 1 AS fold
  FROM (SELECT DISTINCT session FROM targets) CROSS JOIN range({repeats}) AS r(repeat))"""


# One row per session: target y, two features x1 and x2, and a stand-in prediction with uncertainty.
FRAME = (
    c.BARS
    + _PRICE_PART
    + _TARGET_PART
    + """,
fr AS (SELECT t.session, t.target_return AS y, p.seen_return_open_to_close AS x1, p.max_drawdown AS x2,
              p.seen_return_open_to_close AS predicted_return, p.close_volatility AS predicted_uncertainty
       FROM targets t JOIN price p USING (session))"""
)


def inputs(spark, sf_dir):
    """(seen bars, unseen bars, headlines) from one pass over the ticks."""
    placed = c.placed_ticks(spark, sf_dir)
    bars = materialize(adapters.bars_from_ticks(placed), "bars")
    return adapters.seen(bars), adapters.unseen(bars), adapters.headlines_from_ticks(placed)


def frame(spark, sf_dir):
    bars = materialize(adapters.bars_from_lineitem(c.lineitem(spark, sf_dir)), "bars")
    seen, unseen = adapters.seen(bars), adapters.unseen(bars)
    block = price.price_block(seen).select(
        "session",
        F.col("seen_return_open_to_close").alias("x1"),
        F.col("max_drawdown").alias("x2"),
        F.col("seen_return_open_to_close").alias("predicted_return"),
        F.col("close_volatility").alias("predicted_uncertainty"),
    )
    y = targets.build_targets(seen, unseen).select("session", F.col("target_return").alias("y"))
    return materialize(y.join(block, "session"), "frame")


# --- matrix ---------------------------------------------------------------------------------


@query(
    "session_filter",
    tidy_sql(
        c.BARS_HEADLINES
        + """,
q AS (SELECT * FROM seen WHERE session IN (SELECT session FROM headlines WHERE bar_ix >= 45))""",
        f"{D} bar_ix:i open high low close",
        "q",
    ),
)
def session_filter(spark, sf_dir):
    """Seen bars of sessions that have a headline in the last five seen bars."""
    placed = c.placed_ticks(spark, sf_dir)
    late = adapters.headlines_from_ticks(placed).where(F.col("bar_ix") >= 45)
    return tidy(matrix.restrict(adapters.seen(adapters.bars_from_ticks(placed)), late))


_SEQ = text_queries._sequence_sql("s", "session")


@query(
    "feature_matrix",
    tidy_sql(
        c.BARS_HEADLINES
        + ","
        + text_queries._EVENTS
        + _SEQ
        + _PRICE_PART
        + ",\nq AS (SELECT p.session, "
        + ", ".join(f"p.{x} AS price__{x}" for x in price.PRICE_COLUMNS)
        + ", "
        + ", ".join(f"coalesce(s.{x}, 0) AS seq__{x}" for x in sequence.SEQUENCE_COLUMNS)
        + " FROM price p LEFT JOIN seq_s s USING (session))",
        " ".join([D, *[f"price__{x}" for x in price.PRICE_COLUMNS], *[f"seq__{x}" for x in sequence.SEQUENCE_COLUMNS]]),
        "q",
        5,
    ),
)
def feature_matrix(spark, sf_dir):
    seen, _, headlines = inputs(spark, sf_dir)
    specs = [FeatureSpec("price"), FeatureSpec("headline_sequence", alias="seq")]
    return tidy(build_feature_matrix(specs, Inputs(seen, headlines, seen)).df, 5)


_HEADLINE_FEATURES = [
    *summary.ADDITIVE_COLUMNS,
    *summary.SUMMARY_COLUMNS,
    *text_queries._SLOT_NAMES,
    *[f"w_{x}" for x in summary.SLOT_COLUMNS],
    *sequence.SEQUENCE_COLUMNS,
    *reaction.REACTION_COLUMNS,
]


@query(
    "headline_features",
    tidy_sql(
        text_queries.BARS_COMPANY
        + text_queries._SUMMARY
        + text_queries._SLOTS
        + text_queries._WEIGHTED
        + _SEQ
        + text_queries._REACTION
        + text_queries._BURST
        + """,
q AS (SELECT * FROM summary JOIN slots USING (session) JOIN weighted USING (session) JOIN seq_s USING (session)
      JOIN ag USING (session) JOIN bu USING (session))""",
        " ".join([D, *_HEADLINE_FEATURES]),
        "q",
        8,
    ),
)
def headline_features_query(spark, sf_dir):
    seen, _, headlines = inputs(spark, sf_dir)
    block = headline_features(Inputs(seen, headlines, seen))
    return tidy(block.select("session", *_HEADLINE_FEATURES), 8)


@query(
    "align_columns",
    tidy_sql(
        c.BARS + _PRICE_PART + ",\nq2 AS (SELECT session, close_std, max_drawdown, 0.0::DOUBLE AS absent FROM price)",
        f"{D} absent close_std max_drawdown",
        "q2",
        5,
    ),
)
def align_columns(spark, sf_dir):
    block = price.price_block(c.seen_bars(spark, sf_dir))
    return tidy(matrix.align_columns(block, ["absent", "close_std", "max_drawdown"]), 5)


@query(
    "align_sessions",
    tidy_sql(
        c.HEADLINES
        + """,
u AS (SELECT DISTINCT l_suppkey AS session FROM lineitem),
h AS (SELECT session, count(*) AS n FROM headlines WHERE bar_ix >= 48 GROUP BY session),
q AS (SELECT session, coalesce(n, 0) AS n FROM u LEFT JOIN h USING (session))""",
        f"{D} n:i",
        "q",
    ),
)
def align_sessions(spark, sf_dir):
    rows = c.lineitem(spark, sf_dir)
    late = adapters.headlines_from_lineitem(rows).where(F.col("bar_ix") >= 48)
    counts = late.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return tidy(matrix.align_sessions(counts, rows.select(F.col("l_suppkey").alias("session"))))


@query(
    "fill_by_type",
    """SELECT doc_id, coalesce(lang, '') AS lang, CAST(coalesce(quality, 0) AS BIGINT) AS quality,
              CAST(coalesce(toxic, 0) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""",
)
def fill_by_type(spark, sf_dir):
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = docs.join(adapters.table(spark, sf_dir, "labels"), "doc_id", "left")
    return tidy(matrix.fill_by_type(joined))


@query(
    "coerce_numeric",
    """SELECT event_id AS session, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) + 0.0 AS event_type,
              round(coalesce(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE), 0.0), 6) + 0.0 AS value FROM events""",
)
def coerce_numeric(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("session"), "event_type", F.col("value").cast("string").alias("value")
    )
    text, _ = matrix.split_by_type(rows)
    return tidy(matrix.to_numeric(rows, text))


# --- folds ----------------------------------------------------------------------------------


def _sessions(spark, sf_dir):
    return c.lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("session"))


_SESSION_TARGETS = "targets AS (SELECT DISTINCT l_suppkey AS session FROM lineitem)"


@query("session_folds", tidy_sql(_SESSION_TARGETS + folds_sql(), f"{D} repeat:i seed:i fold:i", "folds"))
def session_folds_query(spark, sf_dir):
    return tidy(session_folds(_sessions(spark, sf_dir)))


@query("repeated_folds", tidy_sql(_SESSION_TARGETS + folds_sql(3), f"{D} repeat:i seed:i fold:i", "folds"))
def repeated_folds(spark, sf_dir):
    return tidy(session_folds(_sessions(spark, sf_dir), n_repeats=3))


@query(
    "holdout_split",
    tidy_sql(
        _SESSION_TARGETS + folds_sql() + ",\nq AS (SELECT session, CASE WHEN fold = 0 THEN 1 ELSE 0 END AS is_valid FROM folds)",
        f"{D} is_valid:i",
        "q",
    ),
)
def holdout_split_query(spark, sf_dir):
    split = holdout_split(_sessions(spark, sf_dir))
    return tidy(split.withColumn("is_valid", F.col("is_valid").cast("int")))


# --- models ---------------------------------------------------------------------------------


def _with_fold(spark, sf_dir):
    rows = frame(spark, sf_dir)
    return rows.join(session_folds(rows).select("session", "fold"), "session")


_FOLDED = FRAME + folds_sql() + ",\nfx AS (SELECT fr.*, fold FROM fr JOIN folds USING (session))"


@query(
    "gram_by_fold",
    tidy_sql(
        _FOLDED
        + """,
l AS (SELECT session, fold, unnest(range(4)) AS i, unnest([1.0, x1, x2, y]) AS v FROM fx),
q AS (SELECT a.fold, a.i, b.i AS j, sum(a.v * b.v) AS value FROM l a JOIN l b USING (session) GROUP BY a.fold, a.i, b.i)""",
        "fold:i i:i j:i value",
        "q",
    ),
)
def gram_by_fold(spark, sf_dir):
    got = collect_moments(_with_fold(spark, sf_dir), ["x1", "x2"], "y", ["fold"], shift=np.zeros(2))
    cells = [
        (f, i, j, float(m.matrix[i, j])) for (_, _, f), m in got.items() for i in range(4) for j in range(4)
    ]
    return tidy(spark.createDataFrame(cells, "fold int, i int, j int, value double"))


@query(
    "standardise",
    tidy_sql(
        FRAME
        + """,
q AS (SELECT session, (x1 - avg(x1) OVER ()) / CASE WHEN stddev_pop(x1) OVER () > 1e-6 THEN stddev_pop(x1) OVER () ELSE 1 END AS x1,
             (x2 - avg(x2) OVER ()) / CASE WHEN stddev_pop(x2) OVER () > 1e-6 THEN stddev_pop(x2) OVER () ELSE 1 END AS x2 FROM fr)""",
        f"{D} x1 x2",
        "q",
    ),
)
def standardise(spark, sf_dir):
    rows = frame(spark, sf_dir).select("session", "x1", "x2")
    return tidy(matrix.standardise(rows, ["x1", "x2"]))


def _train_sums(columns: str) -> str:
    """Sums over each fold's train rows."""
    return f"""
tr AS (SELECT g.f AS fold, {columns} FROM fx CROSS JOIN range(5) AS g(f) WHERE fx.fold <> g.f GROUP BY g.f)"""


_ONE = (
    _FOLDED
    + ","
    + _train_sums("count(*) AS n, avg(x1) AS mx, avg(y) AS my, sum(x1 * x1) AS xx, sum(x1 * y) AS xy")
    + """,
q AS (SELECT fold, (xy - n * mx * my) / (xx - n * mx * mx + 1.0) AS coef,
             my - mx * (xy - n * mx * my) / (xx - n * mx * mx + 1.0) AS intercept FROM tr)"""
)


def _fold_fits(spark, rows, features, kinds, solve):
    """(fold, intercept, coefficients...) of each fold's train rows."""
    got = collect_moments(rows, features, "y", ["fold"], kinds)
    folds = sorted({f for _, _, f in got})
    out = []
    for f in folds:
        train = []
        for k in range(len(kinds)):
            total = got[(k, 0, folds[0])]
            for g in folds[1:]:
                total = total + got[(k, 0, g)]
            train.append(total - got[(k, 0, f)])
        out.append((f, solve(*train)))
    return out


@query("ridge_one_feature", tidy_sql(_ONE, "fold:i coef intercept", "q"))
def ridge_one_feature(spark, sf_dir):
    fits = _fold_fits(spark, _with_fold(spark, sf_dir), ["x1"], [ONE], lambda m: raw_ridge(m, 1.0))
    rows = [(f, float(fit.coef[0]), fit.intercept) for f, fit in fits]
    return tidy(spark.createDataFrame(rows, "fold int, coef double, intercept double"))


_TWO = (
    _FOLDED
    + ","
    + _train_sums(
        "count(*) * covar_pop(x1, x1) + 1.0 AS a, count(*) * covar_pop(x1, x2) AS b, count(*) * covar_pop(x2, x2) + 1.0 AS d, "
        "count(*) * covar_pop(x1, y) AS p, count(*) * covar_pop(x2, y) AS q, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my"
    )
    + """,
cf AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS coef_1, (a * q - b * p) / (a * d - b * b) AS coef_2 FROM tr),
q AS (SELECT fold, coef_1, coef_2, my - coef_1 * m1 - coef_2 * m2 AS intercept FROM cf)"""
)


@query("ridge_two_features", tidy_sql(_TWO, "fold:i coef_1 coef_2 intercept", "q"))
def ridge_two_features(spark, sf_dir):
    fits = _fold_fits(spark, _with_fold(spark, sf_dir), ["x1", "x2"], [ONE], lambda m: raw_ridge(m, 1.0))
    rows = [(f, float(fit.coef[0]), float(fit.coef[1]), fit.intercept) for f, fit in fits]
    return tidy(spark.createDataFrame(rows, "fold int, coef_1 double, coef_2 double, intercept double"))


_WEIGHTED = (
    _FOLDED.replace("SELECT fr.*, fold FROM", "SELECT fr.*, fold, greatest(power(abs(y), 0.5), 0.25) AS w FROM")
    + ","
    + _train_sums("avg(w) AS mw, sum(w) AS sw, sum(w * x1) AS sx, sum(w * y) AS sy, sum(w * x1 * x1) AS xx, sum(w * x1 * y) AS xy")
    + """,
s AS (SELECT fold, sw / mw AS sw, sx / mw AS sx, sy / mw AS sy, xx / mw AS xx, xy / mw AS xy FROM tr),
cf AS (SELECT fold, (xy - sx * sy / sw) / (xx - sx * sx / sw + 10.0) AS coef, sx / sw AS mx, sy / sw AS my FROM s),
rs AS (SELECT cf.fold, coef, my - coef * mx AS intercept, sum(w * (y - my - coef * (x1 - mx))) / sum(w) AS rm,
              sum(w * power(y - my - coef * (x1 - mx), 2)) / sum(w) AS r2
       FROM fx JOIN cf ON fx.fold <> cf.fold GROUP BY cf.fold, coef, my, mx),
q AS (SELECT fold, coef, intercept, greatest(sqrt(r2 - rm * rm), 1e-6) AS residual_std FROM rs)"""
)


@query("weighted_ridge", tidy_sql(_WEIGHTED, "fold:i coef intercept residual_std", "q"))
def weighted_ridge_query(spark, sf_dir):
    rows = _with_fold(spark, sf_dir)
    fits = _fold_fits(spark, rows, ["x1"], [abs_power(0.5, 0.25)], lambda m: weighted_ridge(m, 10.0))
    out = [(f, float(fit.coef[0]), fit.intercept, fit.residual_std) for f, fit in fits]
    return tidy(spark.createDataFrame(out, "fold int, coef double, intercept double, residual_std double"))


# Two-by-two solve on z0 = y and z1 = y * standardised x1; weights compared up to scale (ratio and Sharpe).
_SHARPE = (
    FRAME
    + """,
st AS (SELECT y, y * (x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS z FROM fr),
mo AS (SELECT avg(y) AS m0, avg(z) AS m1, var_pop(y) + 0.01 AS a, covar_pop(y, z) AS b, var_pop(z) + 0.01 AS d FROM st),
w AS (SELECT (d * m0 - b * m1) / (a * d - b * b) AS w0, (a * m1 - b * m0) / (a * d - b * b) AS w1 FROM mo),
q AS (SELECT max(w1 / w0) AS slope_to_level, avg(w0 * y + w1 * z) / stddev_pop(w0 * y + w1 * z) * 16 AS sharpe FROM st, w)"""
)


@query("max_sharpe_linear", tidy_sql(_SHARPE, "slope_to_level sharpe", "q"))
def max_sharpe_linear(spark, sf_dir):
    rows = frame(spark, sf_dir).withColumn("cell", F.lit(0))
    got = collect_moments(rows, ["x1"], "y", ["cell"], [ONE, Y_SQUARED])
    m, y2 = got[(0, 0, 0)], got[(1, 0, 0)]
    fit = max_sharpe(m, y2, 0.01)
    mean, scale = standard_scale(m)
    slope = fit.coef[0] * scale[0]
    level = fit.intercept + fit.coef[0] * (m.shift[0] + mean[0])
    out = [(float(slope / level), float(position_sharpe(fit, m, y2)))]
    return tidy(spark.createDataFrame(out, "slope_to_level double, sharpe double"))


def _blocks(*names):
    return tuple(FeatureSpec(n) for n in names)


_COEFS = {"(intercept)": 0.01, "close_volatility": 0.002, "max_drawdown": -0.05, "up_bar_ratio": 0.1, "not_there": 3.0}


@query(
    "linear_scoring",
    tidy_sql(
        c.BARS
        + _PRICE_PART
        + """,
q2 AS (SELECT session, 0.01 + 0.002 * close_volatility - 0.05 * max_drawdown + 0.1 * up_bar_ratio AS predicted_return FROM price)""",
        f"{D} predicted_return",
        "q2",
    ),
)
def linear_scoring(spark, sf_dir):
    block = price.price_block(c.seen_bars(spark, sf_dir))
    items = F.array(
        *[F.struct(F.lit(x).alias("feature"), F.col(x).alias("value")) for x in price.PRICE_COLUMNS]
    )
    long = block.select("session", F.explode(items).alias("i")).select("session", "i.*")
    coefs = spark.createDataFrame(list(_COEFS.items()), "feature string, coef double")
    return tidy(sweep.score_by_table(long, coefs))


@query(
    "ensemble_average",
    tidy_sql(
        bar_queries._STRATEGY_FRAME.split("\ns AS (")[0]
        + """
s AS (SELECT session, 1.0::DOUBLE AS p FROM f UNION ALL SELECT session, r FROM f
      UNION ALL SELECT session, CASE WHEN r >= 0 THEN 1.0 ELSE -1.0 END FROM f
      UNION ALL SELECT session, CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END FROM f),
q AS (SELECT session, avg(p) AS position, count(*) AS n_members FROM s GROUP BY session)""",
        f"{D} position n_members",
        "q",
    ),
)
def ensemble_average(spark, sf_dir):
    members = targets.strategy_positions(bar_queries.strategy_frame(spark, sf_dir), random=False)
    wanted = members.where(F.col("strategy").isin("always_buy", "momentum", "momentum_sign", "buy_losers"))
    return tidy(evaluate.ensemble_average(wanted, "position"))


# --- evaluation -----------------------------------------------------------------------------


def _oof_sql(repeats: int, percentile: float = 0.9) -> str:
    return (
        FRAME
        + folds_sql(repeats)
        + f""",
o0 AS (SELECT fr.session, predicted_return, predicted_uncertainty, y AS realized_return, repeat, seed, fold,
              predicted_return / greatest(abs(predicted_uncertainty), 1e-6) AS score FROM fr JOIN folds USING (session)),
sc0 AS (SELECT repeat, fold, quantile_cont(abs(score), {percentile}) AS scale FROM o0 GROUP BY repeat, fold),
oof AS (SELECT *, least(greatest(score / CASE WHEN scale >= 1e-6 THEN scale ELSE 1 END, -1.0), 1.0) * 100 AS target_position,
               least(greatest(score / CASE WHEN scale >= 1e-6 THEN scale ELSE 1 END, -1.0), 1.0) * 100 * realized_return AS pnl
        FROM o0 JOIN sc0 USING (repeat, fold)),
fs AS (SELECT repeat, seed, fold, count(*) AS n_valid,
              CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * 16 ELSE 0 END AS sharpe FROM oof GROUP BY repeat, seed, fold)"""
    )


def _oof(spark, sf_dir, repeats=1, **sizing):
    """The stand-in prediction sized per fold batch."""
    rows = frame(spark, sf_dir)
    folds = session_folds(rows, n_repeats=repeats)
    scored = rows.join(folds, "session").withColumn(
        "score", evaluate.score(F.col("predicted_return"), F.col("predicted_uncertainty"))
    )
    sized = evaluate.size_positions(scored, ["repeat", "fold"], **sizing)
    return sized.withColumnRenamed("y", "realized_return").withColumn(
        "pnl", targets.pnl(F.col("target_position"), F.col("realized_return"))
    )


@query("size_positions", tidy_sql(_oof_sql(1), f"{D} fold:i score target_position", "oof"))
def size_positions(spark, sf_dir):
    return tidy(_oof(spark, sf_dir).select("session", "fold", "score", "target_position"))


@query(
    "size_positions_neutral_band",
    tidy_sql(
        _oof_sql(1, 0.7).replace(
            "predicted_return / greatest(abs(predicted_uncertainty), 1e-6) AS score",
            "CASE WHEN abs(predicted_return / greatest(abs(predicted_uncertainty), 1e-6)) >= 0.05 "
            "THEN predicted_return / greatest(abs(predicted_uncertainty), 1e-6) ELSE 0.0 END AS score",
        ),
        f"{D} fold:i target_position",
        "oof",
    ),
)
def size_positions_neutral_band(spark, sf_dir):
    sized = _oof(spark, sf_dir, percentile=70.0, neutral_band=0.05)
    return tidy(sized.select("session", "fold", "target_position"))


@query("sharpe_by_fold", tidy_sql(_oof_sql(1), "repeat:i seed:i fold:i n_valid:i sharpe", "fs"))
def sharpe_by_fold(spark, sf_dir):
    return tidy(evaluate.fold_sharpes(_oof(spark, sf_dir)))


@query(
    "sharpe_epsilon",
    tidy_sql(
        _oof_sql(1) + ",\nq2 AS (SELECT fold, avg(pnl) / (stddev_pop(pnl) + 1e-9) * 16 AS sharpe FROM oof GROUP BY fold)",
        "fold:i sharpe",
        "q2",
    ),
)
def sharpe_epsilon(spark, sf_dir):
    return tidy(_oof(spark, sf_dir).groupBy("fold").agg(targets.sharpe_epsilon(F.col("pnl")).alias("sharpe")))


@query(
    "oof_repeat_average",
    tidy_sql(
        _oof_sql(3)
        + """,
q2 AS (SELECT session, avg(predicted_return) AS predicted_return, avg(predicted_uncertainty) AS predicted_uncertainty,
              avg(target_position) AS target_position, min(realized_return) AS realized_return, count(*) AS cv_prediction_count,
              avg(target_position) * min(realized_return) AS pnl FROM oof GROUP BY session)""",
        f"{D} predicted_return predicted_uncertainty target_position realized_return cv_prediction_count pnl",
        "q2",
    ),
)
def oof_repeat_average(spark, sf_dir):
    return tidy(evaluate.average_repeats(_oof(spark, sf_dir, 3)))


@query(
    "repeat_summary",
    tidy_sql(
        _oof_sql(3) + ",\nq2 AS (SELECT repeat, seed, avg(sharpe) AS mean_sharpe FROM fs GROUP BY repeat, seed)",
        "repeat:i seed:i mean_sharpe",
        "q2",
    ),
)
def repeat_summary(spark, sf_dir):
    return tidy(evaluate.repeat_summary(evaluate.fold_sharpes(_oof(spark, sf_dir, 3))))


_STRATEGY_FOLDS = (
    FRAME
    + folds_sql()
    + """,
ps AS (SELECT 'buy' AS strategy, session, 1.0::DOUBLE AS p, y FROM fr UNION ALL SELECT 'trend', session, x1, y FROM fr
       UNION ALL SELECT 'drawdown', session, x2, y FROM fr),
pf AS (SELECT strategy, fold, avg(p * y) / stddev_pop(p * y) * 16 AS sharpe FROM ps JOIN folds USING (session) GROUP BY strategy, fold),
tf AS (SELECT strategy, g.f AS fold, avg(p * y) / stddev_pop(p * y) * 16 AS train_sharpe
       FROM ps JOIN folds USING (session) CROSS JOIN range(5) AS g(f) WHERE folds.fold <> g.f GROUP BY strategy, g.f)"""
)


def _strategy_rows(spark, sf_dir):
    rows = _with_fold(spark, sf_dir)
    kinds = F.array(
        *[
            F.struct(F.lit(n).alias("strategy"), p.alias("position"))
            for n, p in (("buy", F.lit(1.0)), ("trend", F.col("x1")), ("drawdown", F.col("x2")))
        ]
    )
    return rows.select("session", "fold", "y", F.explode(kinds).alias("s")).select("session", "fold", "y", "s.*")


@query(
    "leaderboard",
    tidy_sql(
        _STRATEGY_FOLDS
        + """,
q2 AS (SELECT strategy AS experiment_name, avg(sharpe) AS mean_cv_sharpe, stddev_pop(sharpe) AS std_cv_sharpe,
              1 AS mean_feature_count, count(DISTINCT fold) AS cv_folds,
              row_number() OVER (ORDER BY avg(sharpe) DESC, strategy) AS rank FROM pf GROUP BY strategy)""",
        "experiment_name:s mean_cv_sharpe std_cv_sharpe mean_feature_count cv_folds rank:i",
        "q2",
    ),
)
def leaderboard(spark, sf_dir):
    rows = _strategy_rows(spark, sf_dir).withColumnRenamed("strategy", "experiment_name")
    folds = targets.sharpe_by(rows, ["experiment_name", "fold"], "position", "y")
    return tidy(evaluate.leaderboard(folds.withColumn("feature_count", F.lit(1.0))))


@query(
    "model_leaderboard",
    tidy_sql(
        _STRATEGY_FOLDS
        + """,
q2 AS (SELECT strategy AS model, avg(train_sharpe) AS mean_train_sharpe, avg(sharpe) AS mean_valid_sharpe,
              stddev_samp(sharpe) AS std_valid_sharpe, avg(train_sharpe - sharpe) AS mean_gap,
              row_number() OVER (ORDER BY avg(sharpe) DESC, strategy) AS rank
       FROM pf JOIN tf USING (strategy, fold) GROUP BY strategy)""",
        "model:s mean_train_sharpe mean_valid_sharpe std_valid_sharpe mean_gap rank:i",
        "q2",
    ),
)
def model_leaderboard(spark, sf_dir):
    rows = _strategy_rows(spark, sf_dir)
    # Each row belongs to the train side of the other folds.
    sides = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(4))))
    value = F.col("position") * F.col("y")
    own = F.col("at") == F.col("fold")
    table = sides.groupBy(F.col("strategy").alias("model"), F.col("at").alias("fold")).agg(
        targets.sharpe(F.when(~own, value)).alias("train_sharpe"), targets.sharpe(F.when(own, value)).alias("valid_sharpe")
    )
    return tidy(evaluate.model_leaderboard(table.withColumn("fit_seconds", F.lit(0.0))).drop("mean_fit_seconds"))


# --- experiments ----------------------------------------------------------------------------

# The shipped grid of feature sets and models.
SWEEP_FEATURES = {
    "price": _blocks("price"),
    "price_tech": _blocks("price", "price_technical"),
    "price_parser": _blocks("price", "headline_parser"),
    "price_parser_tfidf": (
        *_blocks("price", "headline_parser"),
        FeatureSpec("headline_tfidf", {"text_source": "body", "min_df": 2, "max_features": 256, "ngram_max": 2}, "body_tfidf"),
    ),
    "price_parser_company_tfidf": (
        *_blocks("price", "headline_parser"),
        FeatureSpec(
            "headline_company_tfidf",
            {"text_source": "body", "top_k": 2, "min_df": 2, "max_features": 192, "ngram_max": 2},
            "company_tfidf",
        ),
    ),
}

SWEEP_MODELS = {
    "linear": build_model("linear"),
    "ridge_a10": build_model("ridge", {"alpha": 10.0}),
    "weighted_linear_wp05": build_model("weighted_linear", {"weight_power": 0.5, "min_weight": 0.25}),
    "weighted_ridge_a10_wp05": build_model("weighted_ridge", {"alpha": 10.0, "weight_power": 0.5, "min_weight": 0.25}),
}


@query(
    "trial_grid",
    tidy_sql(
        _SESSION_TARGETS
        + folds_sql()
        + f""",
a AS (SELECT unnest({list(SWEEP_FEATURES)}) AS f), b AS (SELECT unnest({list(SWEEP_MODELS)}) AS m),
sz AS (SELECT fold, count(*) AS n_valid, (SELECT count(*) FROM targets) - count(*) AS n_train FROM folds GROUP BY fold),
q AS (SELECT 'grid__' || f || '__' || m AS experiment_name, fold, n_train, n_valid FROM a, b, sz)""",
        "experiment_name:s fold:i n_train:i n_valid:i",
        "q",
    ),
)
def trial_grid_query(spark, sf_dir):
    """All trials of the sweep with the fold sizes they will be fitted on."""
    trials = trial_table(spark, trial_grid("grid", SWEEP_FEATURES, SWEEP_MODELS)).select("experiment_name")
    folds = session_folds(_sessions(spark, sf_dir))
    sizes = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_valid"))
    total = sizes.agg(F.sum("n_valid").alias("n_all"))
    sizes = sizes.crossJoin(F.broadcast(total)).select("fold", (F.col("n_all") - F.col("n_valid")).alias("n_train"), "n_valid")
    return tidy(trials.crossJoin(F.broadcast(sizes)))


# Full cross-validation of a one-feature ridge, in closed form.
_CV_ONE = (
    _ONE.replace("\nq AS (SELECT fold, ", "\ncf AS (SELECT fold, ")
    + """,
rs AS (SELECT cf.fold, coef, intercept, greatest(stddev_samp(y - intercept - coef * x1), 1e-6) AS unc
       FROM fx JOIN cf ON fx.fold <> cf.fold GROUP BY cf.fold, coef, intercept),
pr AS (SELECT session, fx.fold, y AS realized_return, intercept + coef * x1 AS predicted_return, unc AS predicted_uncertainty,
              (intercept + coef * x1) / unc AS score FROM fx JOIN rs USING (fold)),
qt AS (SELECT fold, quantile_cont(abs(score), 0.9) AS scale FROM pr GROUP BY fold),
oof AS (SELECT pr.*, least(greatest(score / scale, -1.0), 1.0) * 100 AS target_position,
               least(greatest(score / scale, -1.0), 1.0) * 100 * realized_return AS pnl FROM pr JOIN qt USING (fold))"""
)


@query(
    "cv_experiment",
    tidy_sql(
        _CV_ONE, f"{D} fold:i predicted_return predicted_uncertainty target_position realized_return pnl", "oof"
    ),
)
def cv_experiment(spark, sf_dir):
    seen, unseen, headlines = inputs(spark, sf_dir)
    trial = Trial(
        "one", _blocks("price"), build_model("ridge", {"alpha": 1.0}), columns=("price__seen_return_open_to_close",)
    )
    oof = cross_validate([trial], seen, unseen, headlines).oof
    return tidy(oof.drop("experiment_name", "repeat", "seed"))


@query(
    "cv_fold_summary",
    tidy_sql(
        _CV_ONE
        + """,
q2 AS (SELECT fold, 1 AS feature_count, count(*) AS n_valid, (SELECT count(*) FROM fr) - count(*) AS n_train,
              avg(pnl) / stddev_pop(pnl) * 16 AS sharpe FROM oof GROUP BY fold)""",
        "fold:i feature_count n_train:i n_valid:i sharpe",
        "q2",
    ),
)
def cv_fold_summary(spark, sf_dir):
    seen, unseen, headlines = inputs(spark, sf_dir)
    trial = Trial(
        "one", _blocks("price"), build_model("ridge", {"alpha": 1.0}), columns=("price__seen_return_open_to_close",)
    )
    folds = cross_validate([trial], seen, unseen, headlines).folds
    return tidy(folds.drop("experiment_name", "repeat", "seed"))


# The standardised ridge with feature-driven uncertainty on one feature, in closed form.
_CV_UNCERTAIN = (
    _FOLDED
    + ","
    + _train_sums("count(*) AS n, avg(x1) AS m, CASE WHEN stddev_pop(x1) > 1e-6 THEN stddev_pop(x1) ELSE 1 END AS s, avg(y) AS my")
    + """,
tz AS (SELECT tr.fold, session, y, (x1 - m) / s AS z, my FROM fx JOIN tr ON fx.fold <> tr.fold),
b1 AS (SELECT fold, sum(z * (y - my)) / (sum(z * z) + 2000.0) AS b FROM tz GROUP BY fold),
res AS (SELECT tz.fold, z, abs(y - my - b * z) AS r, ln(1 + abs(y - my - b * z)) AS t FROM tz JOIN b1 USING (fold)),
mt AS (SELECT fold, avg(t) AS t0, greatest(quantile_cont(r, 0.1), 1e-6) AS floor FROM res GROUP BY fold),
u1 AS (SELECT fold, max(t0) AS t0, max(floor) AS floor, sum(z * (t - t0)) / (sum(z * z) + 2000.0) AS u FROM res JOIN mt USING (fold) GROUP BY fold),
pr AS (SELECT session, fx.fold, y AS realized_return, my + b * (x1 - m) / s AS predicted_return,
              greatest(exp(t0 + u * (x1 - m) / s) - 1, floor) AS predicted_uncertainty
       FROM fx JOIN tr USING (fold) JOIN b1 USING (fold) JOIN u1 USING (fold)),
qt AS (SELECT fold, quantile_cont(abs(predicted_return / predicted_uncertainty), 0.7) AS scale FROM pr GROUP BY fold),
oof AS (SELECT pr.*, least(greatest(predicted_return / predicted_uncertainty / scale, -1.0), 1.0) * 100 AS target_position,
               least(greatest(predicted_return / predicted_uncertainty / scale, -1.0), 1.0) * 100 * realized_return AS pnl
        FROM pr JOIN qt USING (fold))"""
)


@query(
    "cv_uncertainty",
    tidy_sql(
        _CV_UNCERTAIN, f"{D} fold:i predicted_return predicted_uncertainty target_position realized_return pnl", "oof"
    ),
)
def cv_uncertainty(spark, sf_dir):
    seen, unseen, headlines = inputs(spark, sf_dir)
    trial = Trial(
        "one", _blocks("price"), build_model("linear"), {"percentile": 70.0}, ("price__seen_return_open_to_close",)
    )
    oof = cross_validate([trial], seen, unseen, headlines).oof
    return tidy(oof.drop("experiment_name", "repeat", "seed"))


@query("sweep")
def sweep_query(spark, sf_dir):
    """Five feature sets by four models, cross-validated together."""
    seen, unseen, headlines = inputs(spark, sf_dir)
    trials = trial_grid("grid", SWEEP_FEATURES, SWEEP_MODELS)
    return cross_validate(trials, seen, unseen, headlines).leaderboard(trials)


# Ridges on one and two price features, with every step from the fit to the leaderboard in closed form.
_SMALL_SETS = {
    "open_close": ("price__seen_return_open_to_close",),
    "drawdown": ("price__max_drawdown",),
    "both": ("price__seen_return_open_to_close", "price__max_drawdown"),
}
_SMALL_ALPHAS = (1.0, 10.0)
_SMALL_ROWS = ", ".join(
    f"('small__{name}__a{alpha:g}', {int('price__seen_return_open_to_close' in columns)}.0, {int('price__max_drawdown' in columns)}.0, {alpha})"
    for name, columns in _SMALL_SETS.items()
    for alpha in _SMALL_ALPHAS
)
_SMALL = (
    _FOLDED
    + f""",
tl AS (SELECT * FROM (VALUES {_SMALL_ROWS}) AS v(experiment_name, u1, u2, alpha)),
tx AS (SELECT experiment_name, alpha, u1 + u2 AS width, session, fold, y, u1 * x1 AS z1, u2 * x2 AS z2 FROM fx CROSS JOIN tl),
tr AS (SELECT experiment_name, g.f AS fold, count(*) * covar_pop(z1, z1) + max(alpha) AS a, count(*) * covar_pop(z1, z2) AS b,
              count(*) * covar_pop(z2, z2) + max(alpha) AS d, count(*) * covar_pop(z1, y) AS p, count(*) * covar_pop(z2, y) AS q,
              avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my
       FROM tx CROSS JOIN range(5) AS g(f) WHERE tx.fold <> g.f GROUP BY experiment_name, g.f),
cf AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS c1, (a * q - b * p) / (a * d - b * b) AS c2 FROM tr),
rs AS (SELECT cf.experiment_name, cf.fold, c1, c2, my - c1 * m1 - c2 * m2 AS c0,
              greatest(stddev_samp(y - (my - c1 * m1 - c2 * m2) - c1 * z1 - c2 * z2), 1e-6) AS unc
       FROM tx JOIN cf ON tx.experiment_name = cf.experiment_name AND tx.fold <> cf.fold GROUP BY cf.experiment_name, cf.fold, c1, c2, my, m1, m2),
pr AS (SELECT tx.*, c0 + c1 * z1 + c2 * z2 AS predicted_return, unc, (c0 + c1 * z1 + c2 * z2) / unc AS score
       FROM tx JOIN rs USING (experiment_name, fold)),
qt AS (SELECT experiment_name, fold, quantile_cont(abs(score), 0.9) AS scale FROM pr GROUP BY experiment_name, fold),
oof AS (SELECT pr.*, least(greatest(score / scale, -1.0), 1.0) * 100 AS target_position,
               least(greatest(score / scale, -1.0), 1.0) * 100 * y AS pnl FROM pr JOIN qt USING (experiment_name, fold)),
fs AS (SELECT experiment_name, fold, max(width) AS width, avg(pnl) / stddev_pop(pnl) * 16 AS sharpe FROM oof GROUP BY experiment_name, fold),
lb AS (SELECT experiment_name, avg(sharpe) AS mean_cv_sharpe, stddev_pop(sharpe) AS std_cv_sharpe, avg(width) AS mean_feature_count,
              count(DISTINCT fold)::DOUBLE AS cv_folds FROM fs GROUP BY experiment_name)"""
)


def _small_results(spark, sf_dir):
    seen, unseen, headlines = inputs(spark, sf_dir)
    trials = [
        Trial(f"small__{name}__a{alpha:g}", _blocks("price"), build_model("ridge", {"alpha": alpha}), columns=columns)
        for name, columns in _SMALL_SETS.items()
        for alpha in _SMALL_ALPHAS
    ]
    trials.append(Trial("unknown", (FeatureSpec("nope"),), build_model("ridge")))
    return cross_validate(trials, seen, unseen, headlines), trials


@query(
    "sweep_small",
    tidy_sql(
        _SMALL
        + """,
q AS (SELECT row_number() OVER (ORDER BY mean_cv_sharpe DESC, experiment_name) AS rank, *, 'price' AS feature_blocks, 'ridge' AS model, 'ok' AS status FROM lb
      UNION ALL SELECT NULL, 'unknown', NULL, NULL, NULL, NULL, '', '', 'error')""",
        "experiment_name:s rank:i mean_cv_sharpe std_cv_sharpe mean_feature_count cv_folds feature_blocks:s model:s status:s",
        "q",
    ),
)
def sweep_small(spark, sf_dir):
    """The leaderboard of six ridges and a trial that cannot be built."""
    results, trials = _small_results(spark, sf_dir)
    return tidy(results.leaderboard(trials).drop("error", "elapsed_seconds", "config_path"))


@query(
    "sweep_small_predictions",
    tidy_sql(
        _SMALL
        + ",\nq AS (SELECT experiment_name, session, fold, predicted_return, unc AS predicted_uncertainty, target_position, pnl FROM oof)",
        f"experiment_name:s {D} fold:i predicted_return predicted_uncertainty target_position pnl",
        "q",
    ),
)
def sweep_small_predictions(spark, sf_dir):
    results, _ = _small_results(spark, sf_dir)
    return tidy(results.oof.drop("repeat", "seed", "realized_return"))


@query(
    "sweep_small_ends",
    tidy_sql(
        _SMALL
        + """,
h AS (SELECT 'head' AS "end", row_number() OVER (ORDER BY mean_cv_sharpe DESC, experiment_name) AS place, experiment_name, mean_cv_sharpe FROM lb),
l AS (SELECT 'tail' AS "end", row_number() OVER (ORDER BY mean_cv_sharpe, experiment_name DESC) AS place, experiment_name, mean_cv_sharpe FROM lb),
q AS (SELECT * FROM h WHERE place <= 2 UNION ALL SELECT * FROM l WHERE place <= 2)""",
        "end:s place:i experiment_name:s mean_cv_sharpe",
        "q",
    ),
)
def sweep_small_ends(spark, sf_dir):
    """The two best and the two worst trials."""
    results, _ = _small_results(spark, sf_dir)
    return tidy(evaluate.board_ends(evaluate.leaderboard(results.folds), "mean_cv_sharpe", 2).select("end", "place", "experiment_name", "mean_cv_sharpe"))


@query(
    "sweep_small_best",
    tidy_sql(
        _SMALL
        + """,
m AS (SELECT experiment_name, unnest(['mean_cv_sharpe', 'std_cv_sharpe']) AS metric, unnest([mean_cv_sharpe, std_cv_sharpe]) AS value FROM lb),
q AS (SELECT metric, experiment_name, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, experiment_name) AS n FROM m) WHERE n = 1)""",
        "metric:s experiment_name:s value",
        "q",
    ),
)
def sweep_small_best(spark, sf_dir):
    """The best trial under each metric."""
    results, _ = _small_results(spark, sf_dir)
    return tidy(evaluate.best_by_metric(evaluate.leaderboard(results.folds), ["mean_cv_sharpe", "std_cv_sharpe"]))


@query("forward_selection")
def forward_selection(spark, sf_dir):
    seen, unseen, headlines = inputs(spark, sf_dir)
    return forward_select(seen, unseen, headlines, _blocks("price"), build_model("ridge", {"alpha": 10.0}), 3)


_MAP_BLOCKS = {
    "text_cw_event_norm__weighted_emb_": "weighted_emb_",
    "text_cw_event_norm__weighted_recent_emb_": "weighted_recent_emb_",
    "text_session_event_norm__session_emb_": "session_emb_",
    "text_session_event_norm__recent_emb_": "recent_emb_",
    "seq__session_emb_": "session_emb_",
    "seq__recent_emb_": "recent_emb_",
}
_MAP_VECTORS = [f"{p}{i:03d}" for p in _MAP_BLOCKS for i in range(text_queries.DIMS)]
_MAP_RELEVANCE = [f"text_cw_event_norm__{x}" for x in RELEVANCE_SUMMARY]
_MAP_SEQUENCE = [f"seq__{x}" for x in sequence.SEQUENCE_COLUMNS]


@query(
    "vector_feature_map",
    tidy_sql(
        text_queries.COMPANY
        + text_queries._VECTORS
        + text_queries._UNNEST
        + text_queries._SUMMARY
        + _SEQ
        + """,
cm AS (SELECT session, company, dim, avg(x) AS m, sum(is_recent * x) / greatest(sum(is_recent), 1e-9) AS r FROM ev GROUP BY session, company, dim),
vl AS (SELECT session, 'weighted_emb_' AS block, dim, sum(relevance_weight * m) AS value FROM cm JOIN scored USING (session, company) GROUP BY session, dim
       UNION ALL SELECT session, 'weighted_recent_emb_', dim, sum(relevance_weight * r) FROM cm JOIN scored USING (session, company) GROUP BY session, dim
       UNION ALL SELECT session, 'session_emb_', dim, avg(x) FROM ev GROUP BY session, dim
       UNION ALL SELECT session, 'recent_emb_', dim, sum(is_recent * x) / greatest(sum(is_recent), 1e-9) FROM ev GROUP BY session, dim),
vw AS (SELECT session, """
        + ", ".join(
            f"max(CASE WHEN block = '{b}' AND dim = {i} THEN value END) AS {p}{i:03d}"
            for p, b in _MAP_BLOCKS.items()
            for i in range(text_queries.DIMS)
        )
        + " FROM vl GROUP BY session),\nq AS (SELECT a.session, "
        + ", ".join(f"coalesce(vw.{x}, 0) AS {x}" for x in _MAP_VECTORS)
        + ", "
        + ", ".join(f"coalesce(sy.{x}, 0) AS text_cw_event_norm__{x}" for x in RELEVANCE_SUMMARY)
        + ", "
        + ", ".join(f"coalesce(sq.{x}, 0) AS seq__{x}" for x in sequence.SEQUENCE_COLUMNS)
        + """ FROM (SELECT DISTINCT l_suppkey AS session FROM lineitem) a LEFT JOIN vw ON a.session = vw.session
      LEFT JOIN summary sy ON a.session = sy.session LEFT JOIN seq_s sq ON a.session = sq.session)""",
        " ".join([D, *_MAP_VECTORS, *_MAP_RELEVANCE, *_MAP_SEQUENCE]),
        "q",
        8,
    ),
)
def vector_feature_map_query(spark, sf_dir):
    n = text_queries.news(spark, sf_dir)
    table = materialize(text_queries._text_vectors(spark, sf_dir, n.parsed), "vectors")
    sessions = c.lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("session"))
    blocks = (*DEFAULT_BLOCKS, VectorBlock("seq", aggregation="session", include_sequence_features=True))
    return tidy(vector_feature_map(n, table, sessions, blocks, dims=text_queries.DIMS), 8)


# --- prediction product ---------------------------------------------------------------------

# Public and private test sessions are folds 0 and 1 of the hash order; the others train.
_SPLIT = _SESSION_TARGETS + folds_sql()
_MOMENTUM_POSITION = (
    FRAME
    + folds_sql()
    + """,
tr AS (SELECT sign(corr(x1, y)) AS d FROM fr JOIN folds USING (session) WHERE fold >= 2),
pos AS (SELECT session, fold, x1 * d * 100 AS target_position FROM fr JOIN folds USING (session), tr WHERE fold < 2)"""
)


def _momentum_split(spark, sf_dir):
    rows = _with_fold(spark, sf_dir)
    direction = rows.where(F.col("fold") >= 2).agg(F.signum(moments_corr(F.col("x1"), F.col("y"))).alias("d"))
    scored = rows.where(F.col("fold") < 2).crossJoin(F.broadcast(direction))
    scored = materialize(scored.select("session", "fold", (F.col("x1") * F.col("d") * 100.0).alias("target_position")))
    return tuple(
        sinks.shape_predictions(scored.where(F.col("fold") == f)) for f in (0, 1)
    )


@query("combine_splits", tidy_sql(_MOMENTUM_POSITION, f"{D} target_position", "pos"))
def combine_splits(spark, sf_dir):
    public, private = _momentum_split(spark, sf_dir)
    return tidy(sinks.combine_splits(public, private))


@query("prediction_file_roundtrip", tidy_sql(_MOMENTUM_POSITION, f"{D} target_position", "pos"))
def prediction_file_roundtrip(spark, sf_dir):
    public, private = _momentum_split(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/positions-{uuid.uuid4().hex}"
    sinks.save_predictions(sinks.combine_splits(public, private), path)
    return tidy(load_predictions(spark, path))


@query(
    "validate_predictions",
    tidy_sql(
        _MOMENTUM_POSITION
        + """,
twice AS (SELECT session FROM pos UNION ALL SELECT session FROM pos WHERE fold = 1),
q2 AS (SELECT 'duplicate' AS check_name, (SELECT count(*) FROM (SELECT session FROM twice GROUP BY session HAVING count(*) > 1)) AS violations
       UNION ALL SELECT 'missing', (SELECT count(*) FROM folds WHERE session NOT IN (SELECT session FROM twice))
       UNION ALL SELECT 'unexpected', (SELECT count(DISTINCT session) FROM twice WHERE session NOT IN (SELECT session FROM folds)))""",
        "check_name:s violations:i",
        "q2",
    ),
)
def validate_predictions(spark, sf_dir):
    """Checks of a file that repeats the private split and lacks the train sessions."""
    public, private = _momentum_split(spark, sf_dir)
    return tidy(sinks.prediction_checks(public.unionByName(private).unionByName(private), _sessions(spark, sf_dir)))


@query(
    "prediction_summary",
    tidy_sql(
        _MOMENTUM_POSITION
        + """,
q2 AS (SELECT count(*) AS n_rows, min(session) AS min_session, max(session) AS max_session, min(target_position) AS min_position,
              max(target_position) AS max_position, avg(target_position) AS mean_position, stddev_samp(target_position) AS std_position FROM pos)""",
        "n_rows:i min_session:i max_session:i min_position max_position mean_position std_position",
        "q2",
    ),
)
def prediction_summary(spark, sf_dir):
    public, private = _momentum_split(spark, sf_dir)
    return tidy(sinks.prediction_summary(public.unionByName(private)))


@query("prediction_product")
def prediction_product_query(spark, sf_dir):
    """Price and TF-IDF ridge fitted on the train folds, both test splits predicted, sized, united, validated."""
    seen, unseen, headlines = inputs(spark, sf_dir)
    headlines = materialize(headlines, "headlines")
    folds = materialize(session_folds(seen), "folds")

    def part(frame, *keep):
        return matrix.restrict(frame, folds.where(F.col("fold").isin(*keep)))

    blocks = (FeatureSpec("price"), FeatureSpec("headline_parser"), SWEEP_FEATURES["price_parser_tfidf"][2])
    trial = Trial("product", blocks, build_model("ridge", {"alpha": 10.0}))
    model = fit_full(trial, part(seen, 2, 3, 4), part(unseen, 2, 3, 4), part(headlines, 2, 3, 4))
    splits = [Split(n, part(seen, f), part(headlines, f)) for n, f in (("public_test", 0), ("private_test", 1))]
    return prediction_product(model, *splits)


# The same on two features in closed form: fitted on folds 2 to 4, folds 0 and 1 sized apart.
_SMALL_PRODUCT = (
    _FOLDED
    + """,
tr AS (SELECT count(*) * covar_pop(x1, x1) + 10.0 AS a, count(*) * covar_pop(x1, x2) AS b, count(*) * covar_pop(x2, x2) + 10.0 AS d,
              count(*) * covar_pop(x1, y) AS p, count(*) * covar_pop(x2, y) AS q, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my
       FROM fx WHERE fold >= 2),
cf AS (SELECT (p * d - q * b) / (a * d - b * b) AS c1, (a * q - b * p) / (a * d - b * b) AS c2, m1, m2, my FROM tr),
rs AS (SELECT c1, c2, my - c1 * m1 - c2 * m2 AS c0, greatest(stddev_samp(y - (my - c1 * m1 - c2 * m2) - c1 * x1 - c2 * x2), 1e-6) AS unc
       FROM fx, cf WHERE fold >= 2 GROUP BY c1, c2, m1, m2, my),
pr AS (SELECT session, fold, (c0 + c1 * x1 + c2 * x2) / unc AS score FROM fx, rs WHERE fold < 2),
qt AS (SELECT fold, quantile_cont(abs(score), 0.9) AS scale FROM pr GROUP BY fold),
q AS (SELECT session, least(greatest(score / scale, -1.0), 1.0) * 100 AS target_position FROM pr JOIN qt USING (fold))"""
)


@query("prediction_product_small", tidy_sql(_SMALL_PRODUCT, f"{D} target_position", "q"))
def prediction_product_small(spark, sf_dir):
    seen, unseen, headlines = inputs(spark, sf_dir)
    folds = materialize(session_folds(seen), "folds")

    def part(frame, *keep):
        return matrix.restrict(frame, folds.where(F.col("fold").isin(*keep)))

    trial = Trial("small", _blocks("price"), build_model("ridge", {"alpha": 10.0}), columns=_SMALL_SETS["both"])
    model = fit_full(trial, part(seen, 2, 3, 4), part(unseen, 2, 3, 4), part(headlines, 2, 3, 4))
    splits = [Split(n, part(seen, f), part(headlines, f)) for n, f in (("public_test", 0), ("private_test", 1))]
    return tidy(prediction_product(model, *splits))


def _step_sql(step: int, source: str) -> str:
    """Mean fold Sharpe of the ridge on z1 and z2 for each candidate of `source` (cand, session, fold, y, z1, z2)."""
    n = f"_{step}"
    return f""",
tx{n} AS ({source}),
tr{n} AS (SELECT cand, g.f AS fold, count(*) * covar_pop(z1, z1) + 10.0 AS a, count(*) * covar_pop(z1, z2) AS b, count(*) * covar_pop(z2, z2) + 10.0 AS d,
                 count(*) * covar_pop(z1, y) AS p, count(*) * covar_pop(z2, y) AS q, avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my
          FROM tx{n} t CROSS JOIN range(5) AS g(f) WHERE t.fold <> g.f GROUP BY cand, g.f),
cf{n} AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS c1, (a * q - b * p) / (a * d - b * b) AS c2 FROM tr{n}),
rs{n} AS (SELECT c.cand, c.fold, c1, c2, my - c1 * m1 - c2 * m2 AS c0,
                 greatest(stddev_samp(y - (my - c1 * m1 - c2 * m2) - c1 * z1 - c2 * z2), 1e-6) AS unc
          FROM tx{n} t JOIN cf{n} c ON t.cand = c.cand AND t.fold <> c.fold GROUP BY c.cand, c.fold, c1, c2, my, m1, m2),
pr{n} AS (SELECT t.cand, t.fold, t.y, (c0 + c1 * z1 + c2 * z2) / unc AS score FROM tx{n} t JOIN rs{n} r ON t.cand = r.cand AND t.fold = r.fold),
qt{n} AS (SELECT cand, fold, quantile_cont(abs(score), 0.9) AS scale FROM pr{n} GROUP BY cand, fold),
fs{n} AS (SELECT cand, fold, avg(least(greatest(score / scale, -1.0), 1.0) * 100 * y) / stddev_pop(least(greatest(score / scale, -1.0), 1.0) * 100 * y) * 16 AS sharpe
          FROM pr{n} JOIN qt{n} USING (cand, fold) GROUP BY cand, fold),
best{n} AS (SELECT cand, avg(sharpe) AS mean_cv_sharpe FROM fs{n} GROUP BY cand ORDER BY 2 DESC, 1 LIMIT 1)"""


_SELECTION = (
    c.BARS
    + _PRICE_PART
    + _TARGET_PART
    + folds_sql()
    + f""",
fl AS (SELECT session, fold, target_return AS y, unnest({["price__" + n for n in price.PRICE_COLUMNS]}) AS f,
              unnest([{", ".join(price.PRICE_COLUMNS)}]) AS x FROM targets JOIN price USING (session) JOIN folds USING (session))"""
    + _step_sql(1, "SELECT f AS cand, session, fold, y, x AS z1, 0.0::DOUBLE AS z2 FROM fl")
    + _step_sql(
        2,
        "SELECT b.f AS cand, b.session, b.fold, b.y, a.x AS z1, b.x AS z2 FROM fl a JOIN best_1 ON a.f = best_1.cand JOIN fl b ON a.session = b.session AND b.f <> a.f",
    )
    + ",\nq AS (SELECT 1 AS step, cand AS feature, mean_cv_sharpe FROM best_1 UNION ALL SELECT 2, cand, mean_cv_sharpe FROM best_2)"
)


@query("forward_selection_two", tidy_sql(_SELECTION, "step:i feature:s mean_cv_sharpe", "q"))
def forward_selection_two(spark, sf_dir):
    """The first two steps over all price features."""
    seen, unseen, headlines = inputs(spark, sf_dir)
    return tidy(forward_select(seen, unseen, headlines, _blocks("price"), build_model("ridge", {"alpha": 10.0}), 2))


_REPEATED = (
    FRAME
    + folds_sql(3)
    + """,
fx AS (SELECT fr.session, y, x1, repeat, fold FROM fr JOIN folds USING (session)),
tr AS (SELECT repeat, g.f AS fold, count(*) * covar_pop(x1, y) / (count(*) * covar_pop(x1, x1) + 1.0) AS c1, avg(x1) AS m1, avg(y) AS my
       FROM fx CROSS JOIN range(5) AS g(f) WHERE fx.fold <> g.f GROUP BY repeat, g.f),
rs AS (SELECT tr.repeat, tr.fold, c1, my - c1 * m1 AS c0, greatest(stddev_samp(y - (my - c1 * m1) - c1 * x1), 1e-6) AS unc
       FROM fx JOIN tr ON fx.repeat = tr.repeat AND fx.fold <> tr.fold GROUP BY tr.repeat, tr.fold, c1, m1, my),
pr AS (SELECT session, y, repeat, fold, c0 + c1 * x1 AS predicted_return, unc, (c0 + c1 * x1) / unc AS score FROM fx JOIN rs USING (repeat, fold)),
qt AS (SELECT repeat, fold, quantile_cont(abs(score), 0.7) AS scale FROM pr GROUP BY repeat, fold),
oof AS (SELECT pr.*, least(greatest(score / scale, -1.0), 1.0) * 100 AS position FROM pr JOIN qt USING (repeat, fold)),
q AS (SELECT session, avg(predicted_return) AS predicted_return, avg(unc) AS predicted_uncertainty, avg(position) AS target_position,
             max(y) AS realized_return, count(*)::DOUBLE AS cv_prediction_count, avg(position) * max(y) AS pnl FROM oof GROUP BY session)"""
)


@query(
    "repeated_cv_small",
    tidy_sql(_REPEATED, f"{D} predicted_return predicted_uncertainty target_position realized_return cv_prediction_count pnl", "q"),
)
def repeated_cv_small(spark, sf_dir):
    """Three repeats of a one-feature ridge, sized at the 70th percentile and averaged."""
    seen, unseen, headlines = inputs(spark, sf_dir)
    trial = Trial("one", _blocks("price"), build_model("ridge", {"alpha": 1.0}), {"percentile": 70.0}, ("price__seen_return_open_to_close",))
    return tidy(evaluate.average_repeats(cross_validate([trial], seen, unseen, headlines, FoldPlan(n_repeats=3)).oof))
