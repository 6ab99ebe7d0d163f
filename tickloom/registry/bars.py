"""Queries over bars: sources, targets, static strategies, price features, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import price, profile, targets
from tickloom.registry import common as c
from tickloom.registry.common import query, tidy, tidy_sql
from tickloom.sources import adapters

D = "session:i"


@query("bars_from_lineitem", tidy_sql(c.BARS, f"{D} bar_ix:i open high low close", "bars"))
def bars_from_lineitem(spark, sf_dir):
    return tidy(c.bars(spark, sf_dir))


@query(
    "bars_from_events",
    tidy_sql(
        """p AS (
  SELECT user_id AS session, row_number() OVER w - 1 AS bar_ix, value AS close,
         coalesce(lag(value) OVER w, value) AS open
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, greatest(open, close) AS high, least(open, close) AS low FROM p)""",
        f"{D} bar_ix:i open high low close",
        "b",
    ),
)
def bars_from_events(spark, sf_dir):
    return tidy(adapters.bars_from_events(adapters.table(spark, sf_dir, "events")))


@query(
    "headlines_fixture",
    tidy_sql(c.HEADLINES, f"{D} bar_ix:i pos:i headline:s", "headlines"),
)
def headlines_fixture(spark, sf_dir):
    return tidy(c.headlines(spark, sf_dir))


def _targets(spark, sf_dir):
    b = c.written_bars(spark, sf_dir)
    return targets.build_targets(adapters.seen(b), adapters.unseen(b))


@query("target_return", tidy_sql(c.TARGETS, f"{D} close_halfway close_end target_return", "targets"))
def target_return(spark, sf_dir):
    b = c.written_bars(spark, sf_dir)
    return tidy(targets.build_targets(adapters.seen(b), adapters.unseen(b)))


_STRATEGY_FRAME = (
    c.TARGETS
    + """,
opening AS (SELECT session, arg_min(open, bar_ix) AS o FROM seen GROUP BY session),
f AS (SELECT session, close_halfway / o - 1 AS r, target_return AS y FROM targets JOIN opening USING (session)),
s AS (
  SELECT 'always_buy' AS strategy, 1.0::DOUBLE AS p, y FROM f
  UNION ALL SELECT 'always_sell', -1.0::DOUBLE, y FROM f
  UNION ALL SELECT 'momentum', r, y FROM f
  UNION ALL SELECT 'mean_reversion', -r, y FROM f
  UNION ALL SELECT 'momentum_sign', CASE WHEN r >= 0 THEN 1.0 ELSE -1.0 END, y FROM f
  UNION ALL SELECT 'perfect', y, y FROM f
  UNION ALL SELECT 'worst', -y, y FROM f
  UNION ALL SELECT 'buy_losers', CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END, y FROM f
  UNION ALL SELECT 'buy_winners', CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END, y FROM f),
q AS (SELECT strategy, avg(p * y) / (stddev_pop(p * y) + 1e-9) * 16 AS sharpe FROM s GROUP BY strategy)"""
)


def strategy_frame(spark, sf_dir):
    b = c.written_bars(spark, sf_dir)
    return targets.strategy_frame(adapters.seen(b), adapters.unseen(b))


@query("static_strategies_sharpe", tidy_sql(_STRATEGY_FRAME, "strategy:s sharpe", "q"))
def static_strategies_sharpe(spark, sf_dir):
    return tidy(targets.strategy_sharpes(strategy_frame(spark, sf_dir), random=False))


_RANDOM = (
    c.TARGETS
    + """,
opening AS (SELECT session, arg_min(open, bar_ix) AS o FROM seen GROUP BY session),
f AS (SELECT session, target_return AS y FROM targets JOIN opening USING (session)),
u AS (SELECT y, (('0x' || substr(md5(session || ':42:1'), 1, 7))::BIGINT + 1)::DOUBLE / 268435457::DOUBLE AS u1,
             (('0x' || substr(md5(session || ':42:2'), 1, 7))::BIGINT + 1)::DOUBLE / 268435457::DOUBLE AS u2 FROM f),
s AS (SELECT sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * y AS v FROM u),
q AS (SELECT 'random_normal' AS strategy, avg(v) / (stddev_pop(v) + 1e-9) * 16 AS sharpe FROM s)"""
)


@query("random_strategy_sharpe", tidy_sql(_RANDOM, "strategy:s sharpe", "q"))
def random_strategy_sharpe(spark, sf_dir):
    return tidy(targets.strategy_sharpes(strategy_frame(spark, sf_dir)).where(F.col("strategy") == "random_normal"))


@query(
    "momentum_heuristic",
    tidy_sql(
        c.TARGETS
        + """,
m AS (SELECT session, arg_max(close, bar_ix) / arg_min(close, bar_ix) - 1 AS momentum FROM seen GROUP BY session),
d AS (SELECT sign(corr(momentum, target_return)) AS direction FROM m JOIN targets USING (session)),
q AS (SELECT session, momentum * direction * 100 AS target_position FROM m, d)""",
        f"{D} target_position",
        "q",
    ),
)
def momentum_heuristic(spark, sf_dir):
    b = c.written_bars(spark, sf_dir)
    return tidy(targets.momentum_positions(adapters.seen(b), adapters.unseen(b), adapters.seen(b)))


_FRAME = c.TARGETS + """,
opening AS (SELECT session, arg_min(open, bar_ix) AS o FROM seen GROUP BY session),
f AS (SELECT session, close_halfway / o - 1 AS seen_return, target_return FROM targets JOIN opening USING (session))"""


@query(
    "cumulative_pnl",
    tidy_sql(
        _FRAME
        + """,
q AS (SELECT session, seen_return * target_return AS pnl,
             sum(seen_return * target_return) OVER (ORDER BY session) AS cumulative_pnl FROM f)""",
        f"{D} pnl cumulative_pnl",
        "q",
    ),
)
def cumulative_pnl(spark, sf_dir):
    frame = strategy_frame(spark, sf_dir)
    return tidy(targets.cumulative_pnl(frame, F.col("seen_return") * F.col("target_return")))


@query(
    "regression_metrics",
    tidy_sql(
        _FRAME
        + """,
q AS (SELECT 1 - sum(power(target_return - seen_return, 2)) / (var_pop(target_return) * count(*)) AS r2,
             avg(power(target_return - seen_return, 2)) AS mse FROM f)""",
        "r2 mse",
        "q",
    ),
)
def regression_metrics(spark, sf_dir):
    return tidy(targets.regression_metrics(strategy_frame(spark, sf_dir), "seen_return", "target_return"))


# --- profile and distributions --------------------------------------------------------------


@query(
    "data_profile",
    tidy_sql(
        """n AS (SELECT count(*) AS n, count(DISTINCT source) AS sessions FROM documents),
u AS (
  SELECT 'doc_id' AS column_name, avg(CASE WHEN doc_id IS NULL THEN 1.0 ELSE 0.0 END) AS null_fraction FROM documents
  UNION ALL SELECT 'text', avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) FROM documents
  UNION ALL SELECT 'lang', avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) FROM documents
  UNION ALL SELECT 'source', avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0.0 END) FROM documents
  UNION ALL SELECT 'n_chars', avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0.0 END) FROM documents),
q AS (SELECT u.*, n.n AS n_rows, 5 AS n_columns, n.sessions AS n_sessions FROM u, n)""",
        "column_name:s null_fraction n_rows:i n_columns:i n_sessions:i",
        "q",
    ),
)
def data_profile(spark, sf_dir):
    return tidy(profile.profile(adapters.table(spark, sf_dir, "documents"), session="source"))


@query(
    "target_distribution",
    tidy_sql(
        c.TARGETS
        + """,
m AS (SELECT avg(target_return) AS mu, stddev_pop(target_return) AS sd FROM targets),
q AS (
  SELECT count(*) AS n, max(mu) AS mean, max(sd) AS std,
         avg(power((target_return - mu) / sd, 3)) AS skew,
         avg(power((target_return - mu) / sd, 4)) - 3 AS excess_kurtosis
  FROM targets, m)""",
        "n:i mean std skew excess_kurtosis",
        "q",
    ),
)
def target_distribution(spark, sf_dir):
    return tidy(profile.distribution(_targets(spark, sf_dir), "target_return"))


@query(
    "target_histogram",
    tidy_sql(
        c.TARGETS
        + """,
t AS (SELECT target_return AS y FROM targets),
b AS (SELECT min(y) AS lo, max(y) AS hi, count(*) AS n FROM t),
k AS (SELECT least(CAST(floor((y - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin FROM t, b),
g AS (SELECT bin, count(*) AS c FROM k GROUP BY bin),
q AS (SELECT i AS bin, lo + i * ((hi - lo) / 50) AS left_edge, coalesce(c, 0) AS n_rows,
             coalesce(c, 0) / (n * ((hi - lo) / 50)) AS density
      FROM range(50) AS r(i) CROSS JOIN b LEFT JOIN g ON g.bin = r.i)""",
        "bin:i left_edge n_rows:i density",
        "q",
    ),
)
def target_histogram(spark, sf_dir):
    return tidy(profile.histogram(_targets(spark, sf_dir), "target_return", 50))


@query(
    "target_qq_normal",
    tidy_sql(
        c.TARGETS
        + """,
t AS (SELECT session, target_return AS y FROM targets),
q AS (SELECT row_number() OVER (ORDER BY y, session) AS rank_no, y AS ordered_value,
             CASE WHEN row_number() OVER (ORDER BY y, session) = count(*) OVER () THEN power(0.5::DOUBLE, 1.0 / count(*) OVER ())
                  WHEN row_number() OVER (ORDER BY y, session) = 1 THEN 1 - power(0.5::DOUBLE, 1.0 / count(*) OVER ())
                  ELSE (row_number() OVER (ORDER BY y, session) - 0.3175) / (count(*) OVER () + 0.365) END AS plot_position
      FROM t)""",
        "rank_no:i ordered_value plot_position",
        "q",
    ),
)
def target_qq_normal(spark, sf_dir):
    b = c.written_bars(spark, sf_dir)
    frame = targets.build_targets(adapters.seen(b), adapters.unseen(b))
    return tidy(profile.qq_positions(frame, "target_return").drop("normal_quantile"))


def _fraction_sql(tables, x):
    """A ratio of polynomials by Horner's rule."""
    parts = []
    for table in tables:
        value = f"{table[0]!r}::DOUBLE"
        for coefficient in table[1:]:
            value = f"({value} * {x} + {coefficient!r}::DOUBLE)"
        parts.append(value)
    return f"{parts[0]} / {parts[1]}"


_QUANTILES = (
    c.TARGETS
    + f""",
t AS (SELECT session, target_return AS y FROM targets),
o AS (SELECT row_number() OVER (ORDER BY y, session) AS rank_no, y AS ordered_value, count(*) OVER () AS n FROM t),
p AS (SELECT rank_no, ordered_value, CASE WHEN rank_no = n THEN power(0.5::DOUBLE, 1.0 / n) WHEN rank_no = 1 THEN 1 - power(0.5::DOUBLE, 1.0 / n)
             ELSE (rank_no - 0.3175) / (n + 0.365) END AS plot_position FROM o),
r AS (SELECT *, plot_position - 0.5 AS d, sqrt(-ln(least(plot_position, 1 - plot_position))) AS r FROM p),
q AS (SELECT rank_no, ordered_value, plot_position,
        CASE WHEN abs(d) <= 0.425 THEN d * {_fraction_sql(profile.CENTRE, "(0.180625 - d * d)")}
             ELSE sign(d) * CASE WHEN r <= 5 THEN {_fraction_sql(profile.MIDDLE, "(r - 1.6)")} ELSE {_fraction_sql(profile.TAIL, "(r - 5)")} END
        END AS normal_quantile FROM r)"""
)


@query("target_qq_quantiles", tidy_sql(_QUANTILES, "rank_no:i ordered_value plot_position normal_quantile", "q"))
def target_qq_quantiles(spark, sf_dir):
    return tidy(profile.qq_positions(_targets(spark, sf_dir), "target_return"))


# --- price blocks ---------------------------------------------------------------------------

_ROWS = """,
rows0 AS (
  SELECT session, bar_ix, open, high, low, close,
         row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session) AS n,
         lag(close) OVER w AS prev,
         max(close) OVER (PARTITION BY session ORDER BY bar_ix) AS peak
  FROM seen WINDOW w AS (PARTITION BY session ORDER BY bar_ix)),
rets AS (SELECT *, close - prev AS change, (close - prev) / greatest(prev, 1e-6) AS ret FROM rows0)"""

_PRICE = (
    c.BARS
    + _ROWS
    + """,
e AS (SELECT session, arg_min(open, i) AS o, arg_min(close, i) AS c0, arg_max(close, i) AS c1,
             max(CASE WHEN i = n - 6 THEN close END) AS b5, max(CASE WHEN i = n - 11 THEN close END) AS b10,
             max(high) AS hi, min(low) AS lo, avg(close) AS close_mean, stddev_pop(close) AS close_std,
             stddev_pop(ret) AS close_volatility, sqrt(avg(ret * ret)) AS realized_volatility,
             avg((high - low) / greatest(open, 1e-6)) AS intrabar_range_mean,
             avg(CASE WHEN close >= open THEN 1.0 ELSE 0.0 END) AS up_bar_ratio,
             avg(CASE WHEN change >= 0 THEN 1.0 WHEN change < 0 THEN 0.0 END) AS positive_close_change_ratio,
             min(close / greatest(peak, 1e-6) - 1) AS max_drawdown,
             (avg(close * bar_ix) - avg(close) * avg(bar_ix)) / var_pop(bar_ix) AS trend_slope
      FROM rets GROUP BY session),
q AS (SELECT *, c1 / o - 1 AS seen_return_open_to_close, c1 / c0 - 1 AS seen_return_close_to_close,
             hi / o - 1 AS seen_high_return, lo / o - 1 AS seen_low_return,
             coalesce(c1 / b5 - 1, 0) AS tail_return_5, coalesce(c1 / b10 - 1, 0) AS tail_return_10,
             trend_slope / greatest(close_mean, 1e-6) AS trend_slope_normalized
      FROM e)"""
)


@query("price_block", tidy_sql(_PRICE, " ".join([D, *price.PRICE_COLUMNS]), "q", 8))
def price_block(spark, sf_dir):
    return tidy(price.price_block(c.seen_bars(spark, sf_dir)), 8)


# The recurrences are folded over ordered lists here: an independent form of the closed sums.
_TECH = (
    c.BARS
    + _ROWS
    + """,
lists AS (
  SELECT session, count(*) AS n, list(close ORDER BY i) AS c, list(change ORDER BY i) FILTER (WHERE i > 0) AS d
  FROM rets GROUP BY session),
ema AS (
  SELECT session, n, c[n] AS last, c[n - 5] AS b5, c[n - 10] AS b10, c[n - 20] AS b20, d,
    list_reduce(c, lambda a, x: a * (9.0::DOUBLE / 11) + x) / list_sum([power(9.0::DOUBLE / 11, k) for k in range(n)]) AS ema10,
    list_reduce(c, lambda a, x: a * (29.0::DOUBLE / 31) + x) / list_sum([power(29.0::DOUBLE / 31, k) for k in range(n)]) AS ema30
  FROM lists),
legs AS (
  SELECT *,
    list_reduce(list_prepend(list_sum([greatest(x, 0.0) for x in d[1:15]]) / 14, [greatest(x, 0.0) for x in d[15:]]),
                lambda a, x: (a * 13 + x) / 14) AS up,
    list_reduce(list_prepend(list_sum([greatest(-x, 0.0) for x in d[1:15]]) / 14, [greatest(-x, 0.0) for x in d[15:]]),
                lambda a, x: (a * 13 + x) / 14) AS down
  FROM ema)"""
)


def _technical(spark, sf_dir, columns, digits=5):
    block = price.technical_block(c.seen_bars(spark, sf_dir))
    return tidy(block.select("session", *columns), digits)


_MOMENTUM = ["ret_last_5", "ret_last_10", "ret_last_20", "ema_10_30_cross", "price_vs_ema10"]


@query(
    "technical_momentum_ema",
    tidy_sql(
        _TECH
        + """,
q AS (SELECT session, last / b5 - 1 AS ret_last_5, last / b10 - 1 AS ret_last_10, last / b20 - 1 AS ret_last_20,
             ema10 / greatest(ema30, 1e-6) - 1 AS ema_10_30_cross, last / greatest(ema10, 1e-6) - 1 AS price_vs_ema10
      FROM legs)""",
        " ".join([D, *_MOMENTUM]),
        "q",
        5,
    ),
)
def technical_momentum_ema(spark, sf_dir):
    return _technical(spark, sf_dir, _MOMENTUM)


@query(
    "technical_rsi",
    tidy_sql(
        _TECH
        + """,
q AS (SELECT session, CASE WHEN n <= 15 THEN 50.0 WHEN down = 0 THEN 100.0
                           ELSE 100 - 100 / (1 + up / down) END AS rsi_14 FROM legs)""",
        f"{D} rsi_14",
        "q",
    ),
)
def technical_rsi(spark, sf_dir):
    return _technical(spark, sf_dir, ["rsi_14"], 6)


_MOMENTS = (
    c.BARS
    + _ROWS
    + """,
mu AS (SELECT session, avg(ret) AS m, stddev_pop(ret) AS s FROM rets GROUP BY session),
mom AS (SELECT session, avg(power((ret - m) / s, 3)) AS ret_skew, avg(power((ret - m) / s, 4)) - 3 AS ret_kurt,
               avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS green_bar_ratio,
               avg((high - low) / greatest(open, 1e-6)) AS avg_bar_spread
        FROM rets JOIN mu USING (session) GROUP BY session)"""
)
_MOMENT_COLUMNS = ["ret_skew", "ret_kurt", "green_bar_ratio", "avg_bar_spread"]


@query("technical_moments", tidy_sql(_MOMENTS, " ".join([D, *_MOMENT_COLUMNS]), "mom"))
def technical_moments(spark, sf_dir):
    return _technical(spark, sf_dir, _MOMENT_COLUMNS, 6)


_AUTOCORR = (
    c.BARS
    + _ROWS
    + """,
ac AS (SELECT a.session, corr(a.ret, b.ret) AS autocorr_1
       FROM rets a JOIN rets b ON a.session = b.session AND b.i = a.i + 1 WHERE a.i > 0 GROUP BY a.session),
ac5 AS (SELECT a.session, corr(a.ret, b.ret) AS autocorr_5
       FROM rets a JOIN rets b ON a.session = b.session AND b.i = a.i + 5 WHERE a.i > 0 GROUP BY a.session),
acs AS (SELECT * FROM ac JOIN ac5 USING (session))"""
)


@query("technical_autocorr", tidy_sql(_AUTOCORR, f"{D} autocorr_1 autocorr_5", "acs"))
def technical_autocorr(spark, sf_dir):
    return _technical(spark, sf_dir, ["autocorr_1", "autocorr_5"], 6)


_FOURIER = (
    c.BARS
    + _ROWS
    + """,
cm AS (SELECT session, avg(close) AS m FROM rets GROUP BY session),
amp AS (SELECT session, k, sqrt(power(sum((close - m) * cos(2 * pi() * k * i / n)), 2)
                              + power(sum((close - m) * sin(2 * pi() * k * i / n)), 2)) AS a
        FROM rets JOIN cm USING (session) CROSS JOIN range(1, 26) AS r(k) WHERE k <= n // 2 GROUP BY session, k),
fr AS (SELECT session, a, row_number() OVER (PARTITION BY session ORDER BY a DESC) AS rn FROM amp),
fq AS (SELECT session, max(CASE WHEN rn = 1 THEN a END) AS fourier_max_freq_amp,
              max(CASE WHEN rn = 2 THEN a END) AS fourier_2nd_freq_amp FROM fr GROUP BY session)"""
)


@query("technical_fourier", tidy_sql(_FOURIER, f"{D} fourier_max_freq_amp fourier_2nd_freq_amp", "fq", 8))
def technical_fourier(spark, sf_dir):
    return _technical(spark, sf_dir, ["fourier_max_freq_amp", "fourier_2nd_freq_amp"], 8)


def _without_base(sql: str, base: str) -> str:
    return sql[len(base):]


_LEGACY = (
    _TECH
    + _without_base(_MOMENTS, c.BARS + _ROWS)
    + _without_base(_AUTOCORR, c.BARS + _ROWS)
    + _without_base(_FOURIER, c.BARS + _ROWS)
    + """,
base AS (
  SELECT session, arg_max(close, i) / arg_min(open, i) - 1 AS seen_return,
         ln(arg_max(close, i)) - ln(arg_min(open, i)) AS log_return, stddev_samp(close) AS seen_volatility,
         max(high) / arg_max(close, i) AS max_high_ratio, min(low) / arg_max(close, i) AS min_low_ratio,
         (max(high) - min(low)) / arg_max(close, i) AS high_low_spread
  FROM rets GROUP BY session),
q AS (SELECT session, seen_return, log_return, seen_volatility, max_high_ratio, min_low_ratio, high_low_spread,
             last / b5 - 1 AS ret_last_5, last / b10 - 1 AS ret_last_10, last / b20 - 1 AS ret_last_20,
             ema10 / ema30 - 1 AS ema_10_30_cross, last / ema10 - 1 AS price_vs_ema10,
             100 - 100 / (1 + up / down) AS rsi_14, ret_skew, ret_kurt, autocorr_1, autocorr_5,
             fourier_max_freq_amp, fourier_2nd_freq_amp, green_bar_ratio, avg_bar_spread
      FROM base JOIN legs USING (session) JOIN mom USING (session) JOIN acs USING (session) JOIN fq USING (session))"""
)


@query("legacy_block", tidy_sql(_LEGACY, " ".join([D, *price.LEGACY_COLUMNS]), "q", 8))
def legacy_block(spark, sf_dir):
    return tidy(price.legacy_block(c.seen_bars(spark, sf_dir)), 8)


@query(
    "feature_correlation",
    tidy_sql(
        _PRICE
        + ",\nlong AS ("
        + " UNION ALL ".join(f"SELECT session, '{p}' AS feature, {p} AS value FROM q" for p in price.PRICE_COLUMNS)
        + """),
cm2 AS (SELECT a.feature AS feature_a, b.feature AS feature_b, corr(a.value, b.value) AS correlation
        FROM long a JOIN long b USING (session) GROUP BY a.feature, b.feature)""",
        "feature_a:s feature_b:s correlation",
        "cm2",
    ),
)
def feature_correlation(spark, sf_dir):
    return tidy(profile.correlation_matrix(price.price_block(c.seen_bars(spark, sf_dir)), price.PRICE_COLUMNS))
