"""Cross-validated fits over whole blocks, each solved again in SQL: normal equations by elimination over lists.

The SQL goes from the ticks to the positions: features, fold vocabularies and category thresholds, means and deviations of each fold's
train side, the system, its solution by Gauss-Jordan steps in a recursive table, residuals, uncertainty, scale.
"""

from __future__ import annotations

from tickloom.operators import price, sequence
from tickloom.plans import evaluate
from tickloom.plans.blocks import FeatureSpec
from tickloom.plans.design import FoldPlan
from tickloom.plans.experiment import Trial, cross_validate
from tickloom.plans.linear import build_model
from tickloom.registry import bars as bar_queries
from tickloom.registry import common as c
from tickloom.registry import models as model_queries
from tickloom.registry import text as text_queries
from tickloom.registry.common import query, tidy, tidy_sql

OOF = "session:i fold:i predicted_return predicted_uncertainty target_position realized_return pnl"


def cells_sql(repeats: int = 1, n_folds: int = 5, seed: int = 42) -> str:
    """`zc` (g, repeat, seed, fold, session, valid, y): every session on its side of every cell."""
    return f"""{model_queries.folds_sql(repeats, n_folds, seed)},
zc AS (SELECT repeat * {n_folds} + f AS g, repeat, seed, f AS fold, fo.session, fo.fold = f AS valid, target_return AS y
       FROM folds fo CROSS JOIN range({n_folds}) AS r(f) JOIN targets USING (session))"""


def plain_sql(columns: list[str], source: str, name: str) -> str:
    """`name` (session, i, v): the columns of `source` numbered from 1, nulls 0."""
    values = ", ".join(f'coalesce("{x}", 0)' for x in columns)
    return f",\n{name} AS (SELECT session, unnest(range(1, {len(columns) + 1})) AS i, unnest(CAST([{values}] AS DOUBLE[])) AS v FROM {source})"


def fit_sql(items: str, kind: str, alpha: float, power: float = 0.0, least: float = 0.0, percentile: float = 0.9) -> str:
    """From `items`, a query for (g, session, i, v) with i from 1 in each cell, to `oof`.

    kind: linear (standardised, uncertainty from features), ridge or weighted.
    """
    weight = f"greatest(power(abs(y), {power}), {least})" if kind == "weighted" else "1.0::DOUBLE"
    scale = "CASE WHEN sqrt(greatest(sum(v * v) / count(*) - avg(v) * avg(v), 0)) > 1e-6 THEN stddev_pop(v) ELSE 1 END" if kind == "linear" else "1.0"

    def solved(tag: str, rhs: str) -> str:
        return f""",
{tag}a AS (SELECT g, list(r ORDER BY i) AS m FROM (
  SELECT z_gm.g, z_gm.i, list_append(list(x + CASE WHEN z_gm.i = z_gm.j THEN {alpha} ELSE 0 END ORDER BY z_gm.j), any_value(h)) AS r
  FROM z_gm JOIN ({rhs}) USING (g, i) GROUP BY z_gm.g, z_gm.i) GROUP BY g),
{tag}j AS (SELECT g, 0 AS k, m FROM {tag}a UNION ALL
  SELECT g, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
    ELSE list_transform(list_zip(r, m[k + 1]), lambda x: x[1] - r[k + 1] * x[2] / m[k + 1][k + 1]) END) FROM {tag}j WHERE k < len(m)),
{tag}b AS (SELECT g, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda r: r[len(m) + 1])) AS b FROM {tag}j WHERE k = len(m)),
{tag}p AS (SELECT g, session, sum(b * z) AS p FROM z_lz JOIN {tag}b USING (g, i) GROUP BY g, session)"""

    out = f""",
z_lx AS ({items}),
z_w0 AS (SELECT *, {weight} AS w0 FROM zc),
z_ws AS (SELECT g, avg(w0) AS wm, count(*) AS n FROM z_w0 WHERE NOT valid GROUP BY g),
z_wt AS (SELECT z_w0.*, w0 / wm AS w FROM z_w0 JOIN z_ws USING (g)),
z_my AS (SELECT g, sum(w * y) / sum(w) AS my FROM z_wt WHERE NOT valid GROUP BY g),
z_mu AS (SELECT g, i, sum(w * v) / sum(w) AS m, {scale} AS s FROM z_lx JOIN z_wt USING (g, session) WHERE NOT valid GROUP BY g, i),
z_lz AS (SELECT g, session, i, (v - m) / s AS z FROM z_lx JOIN z_mu USING (g, i)),
z_tz AS (SELECT z_lz.*, w, y - my AS yc FROM z_lz JOIN z_wt USING (g, session) JOIN z_my USING (g) WHERE NOT valid),
z_gm AS (SELECT a.g, a.i, b.i AS j, sum(a.w * a.z * b.z) AS x FROM z_tz a JOIN z_tz b ON a.g = b.g AND a.session = b.session GROUP BY a.g, a.i, b.i)"""
    out += solved("f", "SELECT g, i, sum(w * z * yc) AS h FROM z_tz GROUP BY g, i")
    out += """,
z_pr AS (SELECT z_wt.*, my + p AS predicted_return, y - my - p AS r FROM z_wt JOIN z_my USING (g) JOIN fp USING (g, session))"""
    if kind == "linear":
        out += """,
z_lt AS (SELECT g, avg(ln(1 + abs(r))) AS t0, greatest(quantile_cont(abs(r), 0.1), 1e-6) AS least FROM z_pr WHERE NOT valid GROUP BY g)"""
        out += solved("u", "SELECT z_tz.g, i, sum(z * (ln(1 + abs(r)) - t0)) AS h FROM z_tz JOIN z_pr USING (g, session) JOIN z_lt ON z_lt.g = z_tz.g GROUP BY z_tz.g, i")
        out += """,
z_un AS (SELECT z_pr.*, greatest(exp(t0 + p) - 1, least) AS predicted_uncertainty FROM z_pr JOIN z_lt USING (g) JOIN up USING (g, session) WHERE valid)"""
    else:
        spread = "stddev_samp(r)" if kind == "ridge" else "sqrt(greatest(sum(w * r * r) / sum(w) - power(sum(w * r) / sum(w), 2), 0))"
        out += f""",
z_rs AS (SELECT g, greatest({spread}, 1e-6) AS predicted_uncertainty FROM z_pr WHERE NOT valid GROUP BY g),
z_un AS (SELECT z_pr.*, predicted_uncertainty FROM z_pr JOIN z_rs USING (g) WHERE valid)"""
    return (
        out
        + f""",
z_sc AS (SELECT *, predicted_return / predicted_uncertainty AS score FROM z_un),
z_qt AS (SELECT g, quantile_cont(abs(score), {percentile}) AS scale FROM z_sc GROUP BY g),
oof AS (SELECT *, y AS realized_return, target_position * y AS pnl
        FROM (SELECT z_sc.*, least(greatest(score / scale, -1.0), 1.0) * 100 AS target_position FROM z_sc JOIN z_qt USING (g)))"""
    )


EVERY = "SELECT g, session, i, v FROM zc JOIN fl USING (session)"


def recursive(*parts: str) -> str:
    return "RECURSIVE " + "".join(parts)


# --- price and technical blocks ---------------------------------------------------------------

_BASE = c.BARS + bar_queries._ROWS
_PRICE = bar_queries._PRICE[len(c.BARS) :].replace("\nq AS (", "\nprice AS (")
_TECHNICAL = (
    "".join(x[len(_BASE) :] for x in (bar_queries._TECH, bar_queries._MOMENTS, bar_queries._AUTOCORR, bar_queries._FOURIER))
    + """,
technical AS (SELECT session, last / b5 - 1 AS ret_last_5, last / b10 - 1 AS ret_last_10, last / b20 - 1 AS ret_last_20,
    ema10 / greatest(ema30, 1e-6) - 1 AS ema_10_30_cross, last / greatest(ema10, 1e-6) - 1 AS price_vs_ema10,
    CASE WHEN legs.n <= 15 THEN 50.0 WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END AS rsi_14, ret_skew, ret_kurt, autocorr_1, autocorr_5,
    fourier_max_freq_amp, fourier_2nd_freq_amp, green_bar_ratio, avg_bar_spread
  FROM legs JOIN mom USING (session) JOIN acs USING (session) JOIN fq USING (session))"""
)
_TARGET = c.TARGETS[len(c.BARS) :]


@query("ridge_full", tidy_sql(recursive(c.BARS, _PRICE, _TARGET, cells_sql(), plain_sql(price.PRICE_COLUMNS, "price", "fl"), fit_sql(EVERY, "ridge", 10.0)), OOF, "oof"))
def ridge_full(spark, sf_dir):
    """Raw ridge over the whole price block: out-of-fold predictions."""
    trial = Trial("ridge_full", (FeatureSpec("price"),), build_model("ridge", {"alpha": 10.0}))
    return _oof(spark, sf_dir, trial)


_TECHNICAL_ITEMS = "SELECT g, session, i, v FROM zc JOIN (SELECT * FROM fl UNION ALL SELECT session, i + {}, v FROM ft) USING (session)".format(len(price.PRICE_COLUMNS))


@query(
    "uncertainty_ridge",
    tidy_sql(
        recursive(
            c.BARS, _PRICE, _TECHNICAL, _TARGET, cells_sql(), plain_sql(price.PRICE_COLUMNS, "price", "fl"),
            plain_sql(price.TECHNICAL_COLUMNS, "technical", "ft"), fit_sql(_TECHNICAL_ITEMS, "linear", 2000.0),
        ),
        OOF,
        "oof",
    ),
)
def uncertainty_ridge(spark, sf_dir):
    """Standardised ridge with feature-driven uncertainty over the price and technical blocks: out-of-fold predictions."""
    trial = Trial("linear", (FeatureSpec("price"), FeatureSpec("price_technical")), build_model("linear"))
    return _oof(spark, sf_dir, trial)


def _oof(spark, sf_dir, trial, plan=FoldPlan()):
    seen, unseen, headlines = model_queries.inputs(spark, sf_dir)
    oof = cross_validate([trial], seen, unseen, headlines, plan, fail_fast=True).oof
    return tidy(oof.drop("experiment_name", *([] if plan.n_repeats > 1 else ["repeat", "seed"])))


@query(
    "weighted_ridge_full",
    tidy_sql(recursive(c.BARS, _PRICE, _TARGET, cells_sql(), plain_sql(price.PRICE_COLUMNS, "price", "fl"), fit_sql(EVERY, "weighted", 10.0, 0.5, 0.25, 0.7)), OOF, "oof"),
)
def weighted_ridge_full(spark, sf_dir):
    """Ridge weighted by the root of the absolute target over the whole price block, sized at the 70th percentile."""
    model = build_model("weighted_ridge", {"alpha": 10.0, "weight_power": 0.5, "min_weight": 0.25})
    return _oof(spark, sf_dir, Trial("weighted", (FeatureSpec("price"),), model, {"percentile": 70.0}))


# --- TF-IDF blocks ----------------------------------------------------------------------------


def text_sql(source: str, cap: int) -> str:
    """`tw` (g, session, i, v): TF-IDF of `source` (slot, session, text) under each cell's train vocabulary; columns numbered from 1."""
    return f""",
tk AS (SELECT slot, session, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM {source}),
grams AS (SELECT slot, session, unnest(t) AS term FROM tk
          UNION ALL SELECT slot, session, unnest([t[i] || '_' || t[i + 1] for i in range(1, len(t))]) FROM tk WHERE len(t) >= 2),
tc AS (SELECT slot, session, term, count(*) AS n FROM grams GROUP BY ALL),
vs AS (SELECT g, slot, term, count(*) AS df, sum(n) AS tf FROM tc JOIN zc USING (session) WHERE NOT valid GROUP BY ALL HAVING count(*) >= 2),
vr AS (SELECT *, row_number() OVER (PARTITION BY g, slot ORDER BY tf DESC, df DESC, term) AS position FROM vs),
nd AS (SELECT g, count(*) AS nd FROM zc WHERE NOT valid GROUP BY g),
vocab AS (SELECT vr.*, ln((1 + nd) / (1.0 + df)) + 1 AS idf, dense_rank() OVER (PARTITION BY g ORDER BY slot, position) AS i
          FROM vr JOIN nd USING (g) WHERE position <= {cap}),
tx AS (SELECT g, slot, session, i, n * idf AS x FROM tc JOIN vocab USING (slot, term)),
ti AS (SELECT g, session, i, x / sqrt(sum(x * x) OVER (PARTITION BY g, slot, session)) AS v FROM tx),
tw AS (SELECT zc.g, zc.session, vocab.i, coalesce(v, 0) AS v FROM zc JOIN vocab USING (g)
       LEFT JOIN ti ON ti.g = zc.g AND ti.session = zc.session AND ti.i = vocab.i)"""


_TWO_PRICES = ["seen_return_open_to_close", "max_drawdown"]


def _with_two_prices(source: str, cap: int) -> str:
    items = "SELECT g, session, i, v FROM zc JOIN fl USING (session) UNION ALL SELECT g, session, i + 2, v FROM tw"
    return text_sql(source, cap) + plain_sql(_TWO_PRICES, "price", "fl") + fit_sql(items, "linear", 2000.0)


_PRICED = c.BARS + _PRICE + _TARGET + "," + c._HEADLINE_ROWS


def _two_prices_and(spec: FeatureSpec, alias: str, labels: list[str], cap: int) -> Trial:
    terms = [f"{alias}__{label}__{i:03d}" for label in labels for i in range(1, cap + 1)]
    return Trial("text", (FeatureSpec("price"), spec), build_model("linear"), columns=(*[f"price__{x}" for x in _TWO_PRICES], *terms))


@query(
    "tfidf_fit",
    tidy_sql(
        recursive(_PRICED, ",", text_queries._EVENTS, text_queries._DOCS, ",\nsd AS (SELECT 0 AS slot, session, text FROM sdoc)", cells_sql(), _with_two_prices("sd", 24)),
        OOF,
        "oof",
    ),
)
def tfidf_fit(spark, sf_dir):
    """Standardised ridge over two price features and a session TF-IDF block with fold vocabularies."""
    spec = FeatureSpec("headline_tfidf", {"max_features": 24}, "tf")
    return _oof(spark, sf_dir, _two_prices_and(spec, "tf", ["session_text"], 24))


@query(
    "company_tfidf_fit",
    tidy_sql(
        recursive(_PRICED, ",", text_queries._COMPANY, text_queries._DOCS, text_queries._SLOT_DOCS, cells_sql(3), _with_two_prices("slotdoc", 12)),
        "repeat:i seed:i " + OOF,
        "oof",
    ),
)
def company_tfidf_fit(spark, sf_dir):
    """Three repeats of a fit over two price features and the TF-IDF of the two most relevant companies."""
    spec = FeatureSpec("headline_company_tfidf", {"max_features": 12}, "tf")
    return _oof(spark, sf_dir, _two_prices_and(spec, "tf", ["top1_text", "top2_text"], 12), FoldPlan(n_repeats=3))


# --- the headline block with its categories ---------------------------------------------------

_CATEGORY_ITEMS = text_queries._CATEGORIES + """,
cn AS (SELECT g, col, sum(CASE WHEN valid THEN 0 ELSE 1 END) AS tr, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS va, max(m) AS m
       FROM cat0 JOIN zc USING (session) GROUP BY g, col),
cl AS (SELECT g, col, va >= m AS held, dense_rank() OVER (PARTITION BY g ORDER BY col) AS i FROM cn WHERE tr >= m),
cv AS (SELECT session, col, sum(relevance_weight) AS v FROM cat0 JOIN scored USING (session, company) GROUP BY session, col),
cw AS (SELECT zc.g, zc.session, cl.i, CASE WHEN valid AND NOT held THEN 0 ELSE coalesce(v, 0) END AS v
       FROM zc JOIN cl USING (g) LEFT JOIN cv ON cv.session = zc.session AND cv.col = cl.col)"""
_PARSER = model_queries._HEADLINE_FEATURES
_PARSER_SQL = (
    text_queries.BARS_COMPANY + text_queries._SUMMARY + text_queries._SLOTS + text_queries._WEIGHTED + model_queries._SEQ + text_queries._REACTION + text_queries._BURST
    + ",\nparser AS (SELECT * FROM summary JOIN slots USING (session) JOIN weighted USING (session) JOIN seq_s USING (session) JOIN ag USING (session) JOIN bu USING (session))"
)
_PARSER_ITEMS = f"SELECT g, session, i, v FROM zc JOIN fl USING (session) UNION ALL SELECT g, session, i + {len(_PARSER)}, v FROM cw"


@query(
    "parser_fit",
    tidy_sql(recursive(_PARSER_SQL, _TARGET, cells_sql(), _CATEGORY_ITEMS, plain_sql(_PARSER, "parser", "fl"), fit_sql(_PARSER_ITEMS, "linear", 2000.0)), OOF, "oof"),
)
def parser_fit(spark, sf_dir):
    """Standardised ridge over the whole headline block, with the category columns that each fold's sides reach."""
    return _oof(spark, sf_dir, Trial("parser", (FeatureSpec("headline_parser"),), build_model("linear")))


_CATEGORY_FIT = _CATEGORY_ITEMS + fit_sql("SELECT g, session, i, v FROM cw", "ridge", 10.0)


def is_category(name: str) -> bool:
    """Whether a matrix column of the headline block is a category."""
    return name.startswith("headline_parser__w_") and "__" in name.removeprefix("headline_parser__w_")


@query("category_fit", tidy_sql(recursive(c.TARGETS_HEADLINES, ",", text_queries._COMPANY, cells_sql(), _CATEGORY_FIT), OOF, "oof"))
def category_fit(spark, sf_dir):
    """Raw ridge over the weighted category sums alone."""
    return _oof(spark, sf_dir, Trial("categories", (FeatureSpec("headline_parser"),), build_model("ridge", {"alpha": 10.0}), columns=is_category))


# --- repeats ----------------------------------------------------------------------------------

_REGIME_TWO = ["weighted_vol_scaled_polarity_3_mean", "weighted_vol_scaled_polarity_5_mean"]
_REPEATED_ITEMS = "SELECT g, session, i, v FROM zc JOIN fl USING (session)"
_REPEATED = [*price.PRICE_COLUMNS, *sequence.SEQUENCE_COLUMNS, *_REGIME_TWO]
_REPEATED_SQL = recursive(
    text_queries.BARS_COMPANY,
    _PRICE.replace("rows0", "rows1").replace("rets", "rets1"),
    model_queries._SEQ,
    text_queries._REGIME,
    ",\nall_of AS (SELECT * FROM price LEFT JOIN seq_s USING (session) LEFT JOIN reg USING (session))",
    _TARGET,
    cells_sql(10),
    plain_sql(_REPEATED, "all_of", "fl"),
    fit_sql(EVERY, "linear", 2000.0, percentile=0.7),
    """,
av AS (SELECT session, avg(predicted_return) AS predicted_return, avg(predicted_uncertainty) AS predicted_uncertainty, avg(target_position) AS target_position,
              any_value(y) AS realized_return, count(*)::DOUBLE AS cv_prediction_count, avg(target_position) * any_value(y) AS pnl FROM oof GROUP BY session)""",
)


@query(
    "repeated_cv_experiment",
    tidy_sql(_REPEATED_SQL, "session:i predicted_return predicted_uncertainty target_position realized_return cv_prediction_count pnl", "av"),
)
def repeated_cv_experiment(spark, sf_dir):
    """Ten repeats of price, sequence and two regime columns, sized at the 70th percentile."""
    seen, unseen, headlines = model_queries.inputs(spark, sf_dir)
    blocks = (FeatureSpec("price"), FeatureSpec("headline_sequence"), FeatureSpec("headline_regime_context", {"include_columns": _REGIME_TWO}))
    trial = Trial("regime_small_p70", blocks, build_model("linear"), {"percentile": 70.0, "neutral_band": 0.0})
    cv = cross_validate([trial], seen, unseen, headlines, FoldPlan(n_repeats=10), fail_fast=True)
    return tidy(evaluate.average_repeats(cv.oof))
