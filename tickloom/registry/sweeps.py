"""Sweeps of position models, every model's system solved again in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import price
from tickloom.operators.folds import session_folds
from tickloom.plans import sweep
from tickloom.plans.linear import Model, build_model
from tickloom.registry import bars as bar_queries
from tickloom.registry import common as c
from tickloom.registry import models as model_queries
from tickloom.registry.common import query, tidy, tidy_sql
from tickloom.session import materialize
from tickloom.sources import sinks

MODELS = (
    {f"sharpe_l{p}": build_model("max_sharpe", {"penalty": p}) for p in (0.0, 0.001, 0.01, 0.1, 1.0)}
    | {f"ridge_a{a}": build_model("ridge", {"alpha": a}) for a in (0.1, 1.0, 10.0, 100.0)}
    | {f"standardised_a{a}": build_model("linear", {"alpha": a}) for a in (20.0, 200.0, 2000.0)}
    | {
        f"weighted_p{p}_a{a}": build_model("weighted_ridge", {"alpha": a, "weight_power": p, "min_weight": 0.25})
        for p in (0.5, 1.0)
        for a in (1.0, 10.0)
    }
)


def _model_row(name: str, model: Model) -> str:
    p = model.params
    kind = {"max_sharpe": "sharpe", "linear": "linear", "ridge": "ridge", "weighted_ridge": "weighted"}[model.name]
    alpha = p.get("penalty", p.get("alpha"))
    return f"('{name}', '{kind}', {alpha!r}::DOUBLE, {p.get('weight_power', 0.0)!r}::DOUBLE, {p.get('min_weight', 0.0)!r}::DOUBLE)"


def sweep_sql(cells: str, models: dict[str, Model] = MODELS) -> str:
    """Positions `ps` (model, g, session, valid, y, p) of every model on the older block for `cells` (g, session, valid)."""
    block = bar_queries._LEGACY[len(c.BARS) :].replace("\nq AS (", "\nlegacy AS (")
    values = ", ".join(f"coalesce({x}, 0)" for x in price.LEGACY_COLUMNS)
    return "RECURSIVE " + c.BARS + block + model_queries._TARGET_PART + model_queries.folds_sql() + f""",
z_v AS (SELECT session, unnest(range(1, {len(price.LEGACY_COLUMNS) + 1})) AS i, unnest(CAST([{values}] AS DOUBLE[])) AS v FROM legacy),
z_c AS ({cells}),
z_m AS (SELECT * FROM (VALUES {", ".join(_model_row(n, m) for n, m in models.items())}) AS t(model, kind, alpha, power, least)),
z_r AS (SELECT model, kind, alpha, g, session, valid, target_return AS y, CASE kind WHEN 'weighted' THEN greatest(power(abs(target_return), power), least) ELSE 1.0 END AS w0
        FROM z_c JOIN targets USING (session) CROSS JOIN z_m WHERE session IN (SELECT session FROM legacy)),
z_w AS (SELECT z_r.*, w0 / wm AS w, my FROM z_r JOIN (SELECT model, g, avg(w0) AS wm, sum(w0 * y) / sum(w0) AS my FROM z_r WHERE NOT valid GROUP BY model, g) USING (model, g)),
z_s AS (SELECT model, g, i, sum(w * v) / sum(w) AS m,
               CASE WHEN any_value(kind) NOT IN ('linear', 'sharpe') OR stddev_pop(v) <= 1e-6 THEN 1.0 ELSE stddev_pop(v) END AS s
        FROM z_w JOIN z_v USING (session) WHERE NOT valid GROUP BY model, g, i),
z_z AS (SELECT model, g, session, i, (v - m) / s AS z FROM z_s JOIN z_v USING (i) JOIN (SELECT DISTINCT g, session FROM z_c) USING (g, session)),
z_x AS (SELECT z_w.model, g, session, i, kind, alpha, w, valid, y, my, z FROM z_w JOIN z_z USING (model, g, session)
        UNION ALL SELECT model, g, session, 0, kind, alpha, w, valid, y, my, 1.0 FROM z_w WHERE kind = 'sharpe'),
z_t AS (SELECT model, g, session, i, alpha, w, CASE kind WHEN 'sharpe' THEN z * y ELSE z END AS z, y - my AS yc, kind FROM z_x WHERE NOT valid),
z_g AS (SELECT a.model, a.g, a.i, b.i AS j, CASE any_value(a.kind) WHEN 'sharpe' THEN avg(a.z * b.z) - avg(a.z) * avg(b.z) ELSE sum(a.w * a.z * b.z) END
               + CASE WHEN a.i = b.i THEN any_value(a.alpha) ELSE 0 END AS x
        FROM z_t a JOIN z_t b ON a.model = b.model AND a.g = b.g AND a.session = b.session GROUP BY a.model, a.g, a.i, b.i),
z_h AS (SELECT model, g, i, CASE any_value(kind) WHEN 'sharpe' THEN avg(z) ELSE sum(w * z * yc) END AS h FROM z_t GROUP BY model, g, i),
z_a AS (SELECT model, g, list(r ORDER BY i) AS m FROM (SELECT model, g, i, list_append(list(x ORDER BY j), any_value(h)) AS r FROM z_g JOIN z_h USING (model, g, i) GROUP BY model, g, i) GROUP BY model, g),
z_j AS (SELECT model, g, 0 AS k, m FROM z_a UNION ALL
  SELECT model, g, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
    ELSE list_transform(list_zip(r, m[k + 1]), lambda x: x[1] - r[k + 1] * x[2] / m[k + 1][k + 1]) END) FROM z_j WHERE k < len(m)),
z_b AS (SELECT model, g, unnest(range(len(m))) AS nth, unnest(list_transform(m, lambda r: r[len(m) + 1])) AS b FROM z_j WHERE k = len(m)),
z_i AS (SELECT DISTINCT model, g, i, dense_rank() OVER (PARTITION BY model, g ORDER BY i) - 1 AS nth FROM z_t),
ps AS (SELECT model, g, session, any_value(valid) AS valid, any_value(y) AS y, sum(b * z) + CASE any_value(kind) WHEN 'sharpe' THEN 0 ELSE any_value(my) END AS p
       FROM z_x JOIN z_i USING (model, g, i) JOIN z_b USING (model, g, nth) GROUP BY model, g, session),
sd AS (SELECT model, g, avg(CASE WHEN NOT valid THEN p * y END) / stddev_pop(CASE WHEN NOT valid THEN p * y END) * 16 AS train_sharpe,
              avg(CASE WHEN valid THEN p * y END) / stddev_pop(CASE WHEN valid THEN p * y END) * 16 AS valid_sharpe FROM ps GROUP BY model, g)"""


_FOLDS = "SELECT f AS g, session, fold = f AS valid FROM folds CROSS JOIN range(5) AS r(f)"
_HOLDOUT = "SELECT 0 AS g, session, fold = 0 AS valid FROM folds"
# Without a penalty the direct-Sharpe system of the older block is singular in some folds, and its solution noise: it has no SQL.
PENALISED = {name: model for name, model in MODELS.items() if name != "sharpe_l0.0"}
_HOLDOUT_SQL = ",\nq AS (SELECT model, train_sharpe, valid_sharpe AS val_sharpe, train_sharpe - valid_sharpe AS gap, row_number() OVER (ORDER BY valid_sharpe DESC, model) AS rank FROM sd)"
_FOLDS_SQL = """,
q AS (SELECT model, avg(train_sharpe) AS mean_train_sharpe, avg(valid_sharpe) AS mean_valid_sharpe, stddev_samp(valid_sharpe) AS std_valid_sharpe,
             avg(train_sharpe - valid_sharpe) AS mean_gap, row_number() OVER (ORDER BY avg(valid_sharpe) DESC, model) AS rank FROM sd GROUP BY model)"""


def _holdout(spark, sf_dir, models):
    seen, unseen, _ = model_queries.inputs(spark, sf_dir)
    return tidy(sweep.holdout_sweep(seen, unseen, models).drop("fit_seconds"), 5)


def _folds(spark, sf_dir, models):
    seen, unseen, _ = model_queries.inputs(spark, sf_dir)
    return tidy(sweep.cv_sweep(seen, unseen, models).drop("mean_fit_seconds"), 5)


@query("position_sweep_holdout")
def position_sweep_holdout(spark, sf_dir):
    """Sixteen position models on one 80/20 split."""
    return _holdout(spark, sf_dir, MODELS)


@query("position_sweep_folds")
def position_sweep_folds(spark, sf_dir):
    """Leaderboard of sixteen position models over five folds."""
    return _folds(spark, sf_dir, MODELS)


@query("position_sweep_holdout_penalised", tidy_sql(sweep_sql(_HOLDOUT, PENALISED) + _HOLDOUT_SQL, "model:s train_sharpe val_sharpe gap rank:i", "q", 5))
def position_sweep_holdout_penalised(spark, sf_dir):
    """The fifteen of them that have a penalty, on one 80/20 split."""
    return _holdout(spark, sf_dir, PENALISED)


@query(
    "position_sweep_folds_penalised",
    tidy_sql(sweep_sql(_FOLDS, PENALISED) + _FOLDS_SQL, "model:s mean_train_sharpe mean_valid_sharpe std_valid_sharpe mean_gap rank:i", "q", 5),
)
def position_sweep_folds_penalised(spark, sf_dir):
    """Leaderboard of the fifteen that have a penalty, over five folds."""
    return _folds(spark, sf_dir, PENALISED)


_PRODUCT = {"sharpe": build_model("max_sharpe", {"penalty": 0.01})}


@query(
    "legacy_position_product",
    tidy_sql(
        sweep_sql("SELECT 0 AS g, session, fold < 2 AS valid FROM folds", _PRODUCT) + ",\nq AS (SELECT session, 1000 * p AS target_position FROM ps WHERE valid)",
        "session:i target_position",
        "q",
        4,
    ),
)
def legacy_position_product(spark, sf_dir):
    """Direct-Sharpe positions on the older block, fitted on the train folds and scaled by 1000."""
    seen, unseen, _ = model_queries.inputs(spark, sf_dir)
    design = materialize(sweep.legacy_design(seen, unseen), "legacy")
    rows = design.join(session_folds(design).select("session", "fold"), "session")
    fit = sweep.fit_positions(rows.where(F.col("fold") >= 2), price.LEGACY_COLUMNS, _PRODUCT["sharpe"])
    return tidy(sinks.shape_predictions(sweep.linear_scores(rows.where(F.col("fold") < 2), price.LEGACY_COLUMNS, fit, 1000.0)), 4)
