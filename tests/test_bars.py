import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tickloom.operators.price import LEGACY_COLUMNS, legacy_block, price_block, technical_block, two_largest_amplitudes
from tickloom.operators.profile import correlation_matrix
from tickloom.operators.targets import build_targets, strategy_sharpes
from tickloom.sources.schemas import BARS
from tickloom.sources.tables import dataset_path

LENGTHS = [1, 2, 3, 4, 5, 6, 10, 11, 15, 16, 19, 20, 21, 50]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    rows = []
    for session, n in enumerate(LENGTHS):
        close = np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            o = close[i] * (1 + rng.normal(0, 0.01))
            rows.append((session, i, o, max(o, close[i]) * 1.01, min(o, close[i]) * 0.99, close[i]))
    rows += [(90, i, 2.0, 2.0, 2.0, 2.0) for i in range(30)]
    rows += [(91, i, 1.0, 2.0, 0.5, [0.0, 1e-9, 1.0, 1.5, 1.2, 1.3][i % 6] + 0.1 * (i > 5)) for i in range(24)]
    return pd.DataFrame(rows, columns=["session", "bar_ix", "open", "high", "low", "close"])


@pytest.fixture(scope="module")
def bars(spark, sample):
    # File order must not matter.
    return spark.createDataFrame(sample.sample(frac=1, random_state=0), BARS)


def tail(c, k):
    return c[-1] / c[-1 - k] - 1 if len(c) > k else 0.0


def numpy_price(g):
    o, h, lo, c = (g[x].to_numpy() for x in ("open", "high", "low", "close"))
    d = np.diff(c)
    r = d / np.maximum(c[:-1], 1e-6)
    slope = np.polyfit(g["bar_ix"], c, 1)[0] if len(c) > 1 else 0.0
    peak = np.maximum.accumulate(c)
    return {
        "seen_return_open_to_close": c[-1] / o[0] - 1,
        "seen_high_return": h.max() / o[0] - 1,
        "seen_low_return": lo.min() / o[0] - 1,
        "tail_return_5": tail(c, 5),
        "tail_return_10": tail(c, 10),
        "close_mean": c.mean(),
        "close_std": c.std(),
        "close_volatility": r.std() if len(r) else 0.0,
        "realized_volatility": np.sqrt((r**2).mean()) if len(r) else 0.0,
        "intrabar_range_mean": ((h - lo) / np.maximum(o, 1e-6)).mean(),
        "up_bar_ratio": (c >= o).mean(),
        "positive_close_change_ratio": (d >= 0).mean() if len(d) else 0.0,
        "max_drawdown": (c / np.maximum(peak, 1e-6) - 1).min(),
        "trend_slope": slope,
        "trend_slope_normalized": slope / max(c.mean(), 1e-6),
    }


def wilder(c):
    if len(c) <= 15:
        return 50.0
    d = np.diff(c)
    up, down = d[:15][d[:15] >= 0].sum() / 14, -d[:15][d[:15] < 0].sum() / 14
    for x in d[14:]:
        up, down = (up * 13 + max(x, 0)) / 14, (down * 13 + max(-x, 0)) / 14
    return 100.0 if down == 0 else 100 - 100 / (1 + up / down)


def autocorr(r, k):
    if len(r) <= k or r[:-k].std() <= 1e-12 or r[k:].std() <= 1e-12:
        return 0.0
    return np.corrcoef(r[:-k], r[k:])[0, 1]


def numpy_technical(g):
    o, h, lo, c = (g[x].to_numpy() for x in ("open", "high", "low", "close"))
    r = np.diff(c) / np.maximum(c[:-1], 1e-6)
    e10, e30 = (pd.Series(c).ewm(span=s).mean().iloc[-1] for s in (10, 30))
    z = (r - r.mean()) / r.std() if len(r) > 2 and r.std() > 1e-12 else None
    amps = np.sort(np.abs(np.fft.rfft(c - c.mean()))[1:])[::-1] if len(c) >= 4 else [0.0, 0.0]
    return {
        "ret_last_5": tail(c, 5),
        "ret_last_20": tail(c, 20),
        "ema_10_30_cross": e10 / max(e30, 1e-6) - 1,
        "price_vs_ema10": c[-1] / max(e10, 1e-6) - 1,
        "rsi_14": wilder(c),
        "ret_skew": (z**3).mean() if z is not None else 0.0,
        "ret_kurt": (z**4).mean() - 3 if z is not None and len(r) > 3 else 0.0,
        "autocorr_1": autocorr(r, 1),
        "autocorr_5": autocorr(r, 5),
        "fourier_max_freq_amp": amps[0],
        "fourier_2nd_freq_amp": amps[1],
        "green_bar_ratio": (c > o).mean(),
        "avg_bar_spread": ((h - lo) / np.maximum(o, 1e-6)).mean(),
    }


def check(got, sample, formula):
    got = got.toPandas().set_index("session")
    for session, g in sample.groupby("session"):
        for name, want in formula(g).items():
            assert got.loc[session, name] == pytest.approx(want, rel=1e-7, abs=1e-9), (session, name)
    assert not got.isna().any().any()


def test_price_block(bars, sample):
    # Session 91 starts at close 0, where returns over the first close are undefined.
    check(price_block(bars), sample, numpy_price)


def test_technical_block(bars, sample):
    check(technical_block(bars), sample, numpy_technical)


def test_legacy_block_guards(bars, sample):
    got = legacy_block(bars).toPandas().set_index("session")
    assert list(got.columns) == LEGACY_COLUMNS
    short = [s for s, n in enumerate(LENGTHS) if n < 20]
    assert (got.loc[short, "ret_last_5":] == 0).all().all()
    long = sample[sample.session == LENGTHS.index(50)]
    c = long["close"].to_numpy()
    row = got.loc[LENGTHS.index(50)]
    assert row["seen_volatility"] == pytest.approx(c.std(ddof=1))
    assert row["log_return"] == pytest.approx(np.log(c[-1] / long["open"].iloc[0]))
    assert row["autocorr_5"] == pytest.approx(pd.Series(np.diff(c) / c[:-1]).autocorr(5))
    assert row["rsi_14"] == pytest.approx(wilder(c))
    assert got.loc[90, "rsi_14"] == 100.0 and got.loc[90, "ret_skew"] == 0.0


def test_targets_skip_null_last_close(spark):
    seen = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0, 2.0), (1, 1, 1.0, 1.0, 1.0, None), (2, 0, 1.0, 1.0, 1.0, 1.0)], BARS)
    unseen = spark.createDataFrame([(1, 50, 1.0, 1.0, 1.0, 3.0), (3, 50, 1.0, 1.0, 1.0, 1.0)], BARS)
    rows = build_targets(seen, unseen).collect()
    assert [(r.session, r.close_halfway, r.target_return) for r in rows] == [(1, 2.0, 0.5)]


def test_strategy_sharpe_is_scale_free(spark):
    rows = [(i, 0.01 * (i - 4), 0.02 * ((i * 7) % 5 - 2)) for i in range(10)]
    one = spark.createDataFrame(rows, "session long, seen_return double, target_return double")
    ten = spark.createDataFrame([(s, r * 10, y) for s, r, y in rows], one.schema)
    a, b = (dict(strategy_sharpes(d).collect()) for d in (one, ten))
    assert a["momentum"] == pytest.approx(b["momentum"], rel=1e-5)
    assert a["always_buy"] == -a["always_sell"]


def test_dataset_paths():
    assert dataset_path("/d/", "bars", "seen", "train") == "/d/bars_seen_train.parquet"
    for args in (("seen", "nope"), ("nope", "train"), ("unseen", "public_test")):
        with pytest.raises(ValueError):
            dataset_path("/d", "bars", *args)


def test_correlations_of_many_columns(spark):
    """Three hundred columns, some with gaps, one constant."""
    rng = np.random.default_rng(6)
    p, n = 300, 80
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 1e5 * rng.normal(size=p)
    x[:, 7] = 3.0
    x[rng.random((n, p)) < 0.0005] = np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(3)
    got = correlation_matrix(df, list(frame.columns)).toPandas().pivot(index="feature_a", columns="feature_b", values="correlation")
    got = got.loc[frame.columns, frame.columns].to_numpy()
    assert np.isnan(got[7]).all() and np.isnan(got[:, 7]).all()
    whole = [i for i in range(p) if i != 7 and not np.isnan(x[:, i]).any()]
    assert len(whole) > 250
    assert got[np.ix_(whole, whole)] == pytest.approx(np.corrcoef(x[:, whole].T), abs=1e-9)


def test_amplitudes_need_no_rows_by_frequency(bars):
    plan = technical_block(bars)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ArrowEvalPython" in plan


def test_amplitudes_by_hand():
    lists = [[1.0, 2.0, 3.0], [1.0, 3.0, 2.0, 7.0, 5.0], None, [2.0, None, 4.0, 9.0], [None] * 5, []]
    got = two_largest_amplitudes(pa.array([x if x is not None else [] for x in lists], pa.list_(pa.float64()))).to_pylist()
    for values, pair in zip(lists, got):
        known = [v for v in values or [] if v is not None]
        if not values or len(values) < 4 or not known:
            assert list(pair.values()) == [None, None]
            continue
        x = np.array([0.0 if v is None else v - np.mean(known) for v in values])
        want = np.sort(np.abs(np.fft.rfft(x))[1:])[::-1][:2]
        assert list(pair.values()) == pytest.approx(want.tolist())
