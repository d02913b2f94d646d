"""Optimizers against their conditions, regimes and fractional differences against pandas and direct sums."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import fractional, optimize, regime

DAY = datetime.date(2020, 1, 1)
day = lambda k: DAY + datetime.timedelta(days=k)


def returns(seed=0, rows=60, codes=8):
    rng = np.random.default_rng(seed)
    return (rng.normal(0, 1, (rows, codes)) + rng.normal(0, 1, (rows, 1))) * np.linspace(0.01, 0.05, codes)


def test_shrinkage_is_the_best_mix_with_the_unit_matrix():
    x = returns(1)
    cov = optimize.shrunk_covariance(x)
    centred = x - x.mean(axis=0)
    n, p = x.shape
    sample = centred.T @ centred / n
    target = np.trace(sample) / p * np.eye(p)
    share = (cov - sample)[0, 1] / (target - sample)[0, 1]
    assert np.allclose(cov, (1 - share) * sample + share * target) and 0 < share < 1
    # The published share: mean squared error of the sample's terms over its distance from the target.
    error = sum(((np.outer(r, r) - sample) ** 2).sum() for r in centred) / n**2
    assert share == pytest.approx(error / ((sample - target) ** 2).sum())
    assert np.allclose(optimize.shrunk_covariance(x[:, :1]), sample[:1, :1])
    few = optimize.shrunk_covariance(returns(2, 6, 20))
    assert np.linalg.eigvalsh(few)[0] > 0
    gaps = x.copy()
    gaps[3, 2] = np.nan
    assert np.allclose(optimize.shrunk_covariance(gaps), optimize.shrunk_covariance(np.nan_to_num(gaps)))


@pytest.mark.parametrize("cap", [None, 0.35, 0.2])
@pytest.mark.parametrize("aversion", [0.5, 20.0, 5000.0])
def test_mean_variance_meets_its_conditions(cap, aversion):
    cov, mu = optimize.shrunk_covariance(returns(3)), np.random.default_rng(3).normal(0, 1, 8)
    w = optimize.mean_variance(mu, cov, aversion, cap)
    most = cap or 1.0
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= most + 1e-9
    slope = mu - aversion * cov @ w
    inside = (w > 1e-6) & (w < most - 1e-6)
    level = slope[inside].mean() if inside.any() else (slope[w >= most - 1e-6].min() + slope[w <= 1e-6].max()) / 2
    assert np.allclose(slope[inside], level, atol=1e-4)
    assert (slope[w <= 1e-6] <= level + 1e-4).all() and (slope[w >= most - 1e-6] >= level - 1e-4).all()


def test_equal_risk_and_caps():
    cov = optimize.shrunk_covariance(returns(4))
    w = optimize.risk_parity(cov)
    share = w * (cov @ w) / (w @ cov @ w)
    assert np.allclose(share, 1 / 8)
    assert np.allclose(optimize.risk_parity(np.diag([1.0, 4.0])), [2 / 3, 1 / 3])
    assert np.allclose(optimize.capped(np.array([6.0, 2.0, 1.0, 1.0]), 0.4), [0.4, 0.3, 0.15, 0.15])
    assert np.allclose(optimize.capped(np.array([1.0, 2.0, np.nan]), 0.2), 1 / 3) and np.allclose(optimize.capped(np.zeros(3), None), 1 / 3)


def test_weights_of_each_method_and_their_fallbacks():
    x, scores = returns(5, codes=5), np.array([0.0, 1.0, 2.0, 3.0, np.nan])
    x[:, 0] /= 3
    for m in optimize.METHODS:
        w = optimize.weigh(m, scores, x, cap=0.4)
        assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= 0.4 + 1e-9
    assert optimize.weigh("invvol", scores, x)[0] > optimize.weigh("invvol", scores, x)[4]
    assert np.allclose(optimize.weigh("mv", scores, x[:4]), optimize.weigh("score", scores, x)) and np.allclose(optimize.weigh("rp", scores, x[:4]), 0.2)
    assert np.allclose(optimize.weigh("rank", scores, x), np.array([1, 2, 3, 4, 0]) / 10) and np.allclose(optimize.weigh("score", np.full(5, np.nan), x), 0.2)
    deviation = x.std(axis=0, ddof=1)
    assert np.allclose(optimize.weigh("invvol", scores, x), (1 / deviation) / (1 / deviation).sum())


def test_periods_take_their_own_recent_returns(spark):
    x = returns(6, 80, 4)
    rows = [(f"c{k}", day(t), float(x[t, k])) for t in range(80) for k in range(4) if (t, k) != (75, 1)]
    table = spark.createDataFrame(rows, "code string, date date, ret double")
    held = spark.createDataFrame([(day(79), f"c{k}", float(k)) for k in range(3)] + [(day(40), "c3", 1.0), (day(40), "c0", None), (day(2), "c1", 1.0), (day(2), "c2", 3.0), (DAY - datetime.timedelta(days=9), "c0", 1.0)], "period date, code string, score double")
    got = {(r["method"], r["period"], r["code"]): r["weight"] for r in optimize.period_weights(held, table, ["mv", "rp", "ew"], 30).collect()}
    window = x[50:80, :3].copy()
    window[25, 1] = np.nan
    for m in ("mv", "rp"):
        assert [got[m, day(79), f"c{k}"] for k in range(3)] == pytest.approx(optimize.weigh(m, np.arange(3.0), window).tolist(), abs=1e-9)
    assert [got["rp", day(40), c] for c in ("c0", "c3")] == pytest.approx(optimize.weigh("rp", np.array([np.nan, 1.0]), x[11:41][:, [0, 3]]).tolist(), abs=1e-9)
    assert [got["mv", day(2), c] for c in ("c1", "c2")] == pytest.approx([0, 1], abs=1e-7) and got["mv", DAY - datetime.timedelta(days=9), "c0"] == 1
    with pytest.raises(ValueError):
        optimize.period_weights(held, table, ["best"])


def test_regime_equals_pandas(spark):
    rng = np.random.default_rng(7)
    px = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 400))), index=[day(k) for k in range(400)])
    codes = pd.DataFrame(50 * np.exp(np.cumsum(rng.normal(0, 0.03, (400, 6)), axis=0)), index=px.index, columns=[f"c{k}" for k in range(6)])
    codes[rng.random((400, 6)) < 0.1] = np.nan
    codes.iloc[100:140] = np.nan
    index = spark.createDataFrame([(d, float(v)) for d, v in px.items()], "date date, px double")
    panel = spark.createDataFrame([(c, d, None if np.isnan(v) else float(v)) for c in codes for d, v in codes[c].items()], "code string, date date, close double")
    got = {r["date"]: r for r in regime.position_regime(index, panel).collect()}
    trend = (px / px.rolling(60, min_periods=30).mean() - 1).shift(1)
    vol = px.pct_change().rolling(20, min_periods=10).std()
    calm = (vol / vol.rolling(252, min_periods=60).median()).shift(1)
    breadth = ((codes > codes.rolling(20, min_periods=10).mean()).sum(axis=1) / codes.notna().sum(axis=1).replace(0, np.nan)).shift(1)
    for d in px.index:
        r = got[d]
        parts = [float(trend[d] > 0), float(calm[d] < 1)] + ([] if np.isnan(breadth[d]) else [float(breadth[d] > 0.5)])
        assert r["target_exposure"] == pytest.approx(0.3 + 0.7 * sum(parts) / len(parts))
        for name, want in (("mkt_trend", trend[d]), ("mkt_vol", calm[d]), ("mkt_breadth", breadth[d])):
            assert (r[name] is None) == bool(np.isnan(want)) and (r[name] is None or r[name] == pytest.approx(want))
    assert {r["target_exposure"] for r in regime.position_regime(index, panel, forced=0.5).collect()} == {0.5}
    assert {r["breadth_on"] for r in regime.position_regime(index).collect()} == {None}
    with pytest.raises(ValueError):
        regime.position_regime(index, least_exposure=1.5)


def test_exposure_as_of(spark):
    table = spark.createDataFrame([(day(1), 0.4), (day(3), None), (day(5), 1.7), (day(7), 0.3)], "date date, target_exposure double")
    signals = spark.createDataFrame([(day(k),) for k in (0, 1, 2, 3, 4, 5, 6, 9)], "date date")
    assert {(r["date"] - DAY).days: r["exposure"] for r in regime.exposures(table, signals).collect()} == {0: 1.0, 1: 0.4, 2: 0.4, 3: 1.0, 4: 0.4, 5: 1.0, 6: 1.0, 9: 0.3}
    assert [r["exposure"] for r in regime.exposures(table.limit(0), signals.limit(1), 0.8).collect()] == [0.8]


def test_weights_of_fractional_differences():
    assert fractional.weights(0.5, 1e-9, 4).tolist() == pytest.approx([1, -0.5, -0.125, -0.0625, -0.0390625])
    assert fractional.weights(1.0).tolist() == [1, -1] and fractional.weights(0.0).tolist() == [1]
    w = fractional.weights(0.4, 1e-4)
    assert abs(w[-1]) >= 1e-4 and abs(w[-1] * (0.4 - len(w) + 1) / len(w)) < 1e-4


def test_fractional_differences_of_long_series_with_gaps(spark):
    rng = np.random.default_rng(9)
    series = {"a": np.cumsum(rng.normal(0, 1, 500)), "b": np.cumsum(rng.normal(0, 1, 30))}
    series["a"][450] = np.nan
    df = spark.createDataFrame([(c, day(t), None if np.isnan(v) else float(v)) for c, x in series.items() for t, v in enumerate(x)], "code string, date date, v double").repartition(3)
    w = fractional.weights(0.4, 1e-3)
    got = {(r["code"], (r["date"] - DAY).days): r["x"] for r in fractional.fractional_difference(df, F.col("v"), 0.4, "x", 1e-3).collect()}
    for c, x in series.items():
        used = w[: len(x)]
        for t in range(len(x)):
            window = x[t - len(used) + 1 : t + 1] if t >= len(used) - 1 else np.array([np.nan])
            if np.isnan(window).any():
                assert got[c, t] is None
            else:
                assert got[c, t] == pytest.approx((window[::-1] * used).sum())
    assert fractional.fractional_difference(df.limit(0), F.col("v"), 0.4, "x").count() == 0


def test_unit_roots_are_told_from_stationary_series(spark):
    # Published critical values with a constant: -3.43 at 1 %, -2.86 at 5 %, -2.57 at 10 %.
    assert [fractional.unit_root_p(s) for s in (-3.43, -2.86, -2.57)] == pytest.approx([0.01, 0.05, 0.1], abs=2e-3)
    assert fractional.unit_root_p(-30) == 0 and fractional.unit_root_p(3) == 1
    rng = np.random.default_rng(11)
    walks = {f"c{k}": np.cumsum(rng.normal(0, 1, 400)) for k in range(5)}
    p = [fractional.augmented_dickey_fuller(x) for x in walks.values()]
    assert np.median(p) > 0.05 and max(fractional.augmented_dickey_fuller(np.diff(x)) for x in walks.values()) < 1e-6
    # Without lags the statistic is that of a plain regression of changes on levels.
    x = walks["c0"]
    a = np.column_stack([x[:-1], np.ones(399)])
    beta, rest = np.linalg.lstsq(a, np.diff(x), rcond=None)[:2]
    t = beta[0] / math.sqrt(rest[0] / 397 * np.linalg.inv(a.T @ a)[0, 0])
    assert fractional._regression(x, 0, 0)[0] == pytest.approx(t)
    df = spark.createDataFrame([(c, day(t), float(v)) for c, x in walks.items() for t, v in enumerate(x)], "code string, date date, v double")
    table = fractional.stationarity(df, F.col("v"), [0.0, 0.5, 1.0], 1e-2, codes=4)
    rows = {r["d"]: r for r in table.collect()}
    assert rows[0.0]["median_p"] > 0.05 and rows[1.0]["median_p"] < 1e-6 and {r["n"] for r in rows.values()} == {4}
    assert fractional.optimal_order(table).first()["d"] in (0.5, 1.0)
    assert fractional.optimal_order(table.withColumn("median_p", F.lit(None).cast("double"))).first()["d"] == 1.0
