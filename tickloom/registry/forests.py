"""Regression forests, grown again in SQL: draws, bins, histograms, splits and leaves of every level."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import price
from tickloom.plans import forest as forests
from tickloom.plans import sweep
from tickloom.registry import bars as bar_queries
from tickloom.registry import common as c
from tickloom.registry import models as model_queries
from tickloom.registry.common import query, tidy, tidy_sql
from tickloom.session import materialize

TREES, DEPTH, SEED = 100, 5, 42


def forest_sql(trees: int, depth: int, seed: int = SEED, bins: int = forests.BINS) -> str:
    """From the older block: `wk` (session, tree, node) at the deepest nodes, `sp` (tree, node, f, b, gain), `lf` (tree, node, mean)."""
    block = bar_queries._LEGACY[len(c.BARS) :].replace("\nq AS (", "\nlegacy AS (")
    values = ", ".join(f"coalesce({x}, 0)" for x in price.LEGACY_COLUMNS)
    poisson = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in forests.POISSON)
    out = (
        c.BARS
        + block
        + model_queries._TARGET_PART
        + model_queries.folds_sql()
        + f""",
fy AS (SELECT session, target_return AS y, fold <> 0 AS train FROM targets JOIN folds USING (session) JOIN legacy USING (session)),
fx AS (SELECT session, unnest(range({len(price.LEGACY_COLUMNS)})) AS f, unnest(CAST([{values}] AS DOUBLE[])) AS v FROM legacy JOIN fy USING (session)),
bd AS (SELECT f, min(v) AS lo, (max(v) - min(v)) / {bins} AS width FROM fx JOIN fy USING (session) WHERE train GROUP BY f),
bn AS (SELECT session, f, CASE WHEN width > 0 THEN least(greatest(floor((v - lo) / width), 0), {bins - 1}) ELSE 0 END::INT AS b FROM fx JOIN bd USING (f)),
dw AS (SELECT session, y, train, tree, ('0x' || substr(md5('{seed}:' || tree || ':' || session), 1, 7))::BIGINT::DOUBLE / 268435456 AS u FROM fy CROSS JOIN range({trees}) AS r(tree)),
k0 AS (SELECT session, tree, y, CASE WHEN train THEN {poisson} ELSE 0 END AS w, 1 AS node FROM dw)"""
    )
    for level in range(depth):
        out += f""",
h{level} AS (SELECT tree, node, f, b, sum(w) AS w, sum(w * y) AS wy FROM k{level} JOIN bn USING (session) WHERE w > 0 AND node >= {1 << level} GROUP BY ALL),
p{level} AS (SELECT *, sum(w) OVER o AS lw, sum(wy) OVER o AS ly, sum(w) OVER a AS tw, sum(wy) OVER a AS ty FROM h{level}
  WINDOW o AS (PARTITION BY tree, node, f ORDER BY b), a AS (PARTITION BY tree, node, f)),
g{level} AS (SELECT tree, node, f, b, power(ly, 2) / lw + power(ty - ly, 2) / (tw - lw) - power(ty, 2) / tw AS gain FROM p{level} WHERE lw >= 1 AND tw - lw >= 1),
t{level} AS (SELECT *, max(gain) OVER (PARTITION BY tree, node) AS top FROM g{level} WHERE gain > {forests.LEAST_GAIN}),
s{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY f, b) AS nth FROM t{level} WHERE gain >= top * (1 - {forests.SAME_GAIN})) WHERE nth = 1),
k{level + 1} AS (SELECT k.session, k.tree, k.y, k.w, CASE WHEN s.f IS NULL THEN k.node ELSE 2 * k.node + (bn.b > s.b)::INT END AS node
  FROM k{level} k LEFT JOIN s{level} s ON s.tree = k.tree AND s.node = k.node LEFT JOIN bn ON bn.session = k.session AND bn.f = s.f)"""
    splits = " UNION ALL ".join(f"SELECT tree, node, f, b, gain FROM s{level}" for level in range(depth))
    return (
        out
        + f""",
sp AS ({splits}),
wk AS (SELECT * FROM k{depth}),
lf AS (SELECT tree, node, sum(w * y) / sum(w) AS mean FROM wk WHERE w > 0 GROUP BY tree, node)"""
    )


_NAMES = "CAST([" + ", ".join(f"'{x}'" for x in price.LEGACY_COLUMNS) + "] AS VARCHAR[])"
_IMPORTANCE = f""",
sh AS (SELECT tree, f, sum(gain) / sum(sum(gain)) OVER (PARTITION BY tree) AS share FROM sp GROUP BY tree, f),
im AS (SELECT f, sum(share) / (SELECT sum(share) FROM sh) AS importance FROM sh GROUP BY f),
q AS (SELECT {_NAMES}[r.f + 1] AS feature, coalesce(importance, 0) AS importance FROM range({len(price.LEGACY_COLUMNS)}) AS r(f) LEFT JOIN im ON im.f = r.f)"""


@query("forest", tidy_sql(forest_sql(TREES, DEPTH) + _IMPORTANCE, "feature:s importance", "q", 5))
def forest(spark, sf_dir):
    """Importances of a hundred trees of depth five on the older block."""
    seen, unseen, _ = model_queries.inputs(spark, sf_dir)
    return tidy(sweep.random_forest(seen, unseen, TREES, DEPTH, SEED)[0], 5)


_METRICS = """,
pd AS (SELECT session, avg(mean) AS p FROM wk JOIN lf USING (tree, node) GROUP BY session),
rows0_ AS (SELECT NOT train AS is_valid, y, p FROM pd JOIN fy USING (session)),
q AS (SELECT is_valid::INT AS is_valid, 1 - sum(power(y - p, 2)) / nullif(sum(power(y - my, 2)), 0) AS r2, avg(power(y - p, 2)) AS mse,
             avg(p * y) / stddev_pop(p * y) * 16 AS sharpe
      FROM (SELECT *, avg(y) OVER (PARTITION BY is_valid) AS my FROM rows0_) GROUP BY is_valid)"""


@query("forest_metrics", tidy_sql(forest_sql(TREES, DEPTH) + _METRICS, "is_valid:i r2 mse sharpe", "q", 5))
def forest_metrics(spark, sf_dir):
    """R2, squared error and Sharpe of the forest on either side of the 80/20 split."""
    seen, unseen, _ = model_queries.inputs(spark, sf_dir)
    table = sweep.random_forest(seen, unseen, TREES, DEPTH, SEED)[1]
    return tidy(table.withColumn("is_valid", F.col("is_valid").cast("int")).select("is_valid", "r2", "mse", "sharpe"), 5)


@query(
    "forest_splits",
    tidy_sql(forest_sql(5, 2) + f",\nq AS (SELECT tree, node, {_NAMES}[f + 1] AS feature, b AS bin, gain FROM sp)", "tree:i node:i feature:s bin:i gain", "q"),
)
def forest_splits(spark, sf_dir):
    """Every split of five trees of depth two."""
    seen, unseen, _ = model_queries.inputs(spark, sf_dir)
    design = sweep.legacy_design(seen, unseen)
    rows = materialize(design.join(sweep.holdout_split(design, SEED), "session"), "forest")
    model = forests.grow(rows.where(~F.col("is_valid")), price.LEGACY_COLUMNS, sweep.TARGET, 5, 2, SEED)
    splits = [(t, n, model.columns[f], b, gain) for t, n, f, b, gain, _ in model.splits]
    return tidy(spark.createDataFrame(splits, "tree int, node int, feature string, bin int, gain double"))
