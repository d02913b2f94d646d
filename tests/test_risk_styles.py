"""Decaying weights against pandas' exponential moments and direct sums."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import risk_styles

DAY = datetime.date(2010, 1, 1)


def frame(spark, columns):
    """columns: name to (codes, rows) arrays."""
    codes, n = next(iter(columns.values())).shape
    rows = [(f"c{k}", DAY + datetime.timedelta(days=t), *(None if np.isnan(x[k, t]) else float(x[k, t]) for x in columns.values())) for k in range(codes) for t in range(n)]
    return spark.createDataFrame(rows, "code string, date date, " + ", ".join(f"{c} double" for c in columns)).repartition(3)


def column(df, name, codes):
    rows = df.orderBy("code", "date").collect()
    return [np.array([np.nan if r[name] is None else r[name] for r in rows if r["code"] == f"c{k}"]) for k in range(codes)]


@pytest.fixture(scope="module")
def returns():
    rng = np.random.default_rng(1)
    market = rng.normal(0, 0.01, 300)
    ret = 0.5 + rng.normal(0, 0.02, (3, 300)) - 0.5 + np.array([[0.5], [1.0], [2.0]]) * market
    ret[0, rng.random(300) < 0.2] = np.nan
    ret[1, 150:] = np.nan  # leaves
    return ret, np.tile(np.where(rng.random(300) < 0.02, np.nan, market), (3, 1))


@pytest.mark.parametrize("halflife", [0.5, 2, 20])
def test_market_regression_equals_exponential_moments(spark, returns, halflife):
    ret, market = returns
    window = 40
    got = risk_styles.market_regression(frame(spark, {"ret": ret, "market": market}), "ret", "market", halflife, window)
    betas, sigmas = column(got, "beta", 3), column(got, "hsigma", 3)
    for k in range(3):
        r, m = pd.Series(ret[k]), pd.Series(market[k])
        m = m.where(r.notna())
        r = r.where(m.notna())
        ew = lambda x: x.ewm(halflife=halflife, ignore_na=False).mean()
        enough = r.notna().rolling(window, min_periods=1).sum() >= window // 2
        vr, vm, cov = (ew(r * r) - ew(r) ** 2).clip(lower=0), (ew(m * m) - ew(m) ** 2).clip(lower=0), ew(r * m) - ew(r) * ew(m)
        beta = (cov / vm.replace(0, np.nan)).where(enough)
        # Where few rows carry all the weight, variances near nothing differ by rounding alone.
        firm = (vm > 1e-9) | beta.isna()
        assert np.allclose(betas[k][firm], beta[firm], equal_nan=True, rtol=1e-5, atol=1e-7)
        sigma = np.sqrt((vr - beta**2 * vm).clip(lower=0))
        assert np.allclose(sigmas[k][firm], sigma[firm], equal_nan=True, atol=1e-5)
    assert np.isnan(betas[1][-100:]).all() and not np.isnan(betas[1][100])


def test_sums_over_many_blocks_neither_overflow_nor_lose_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1, 1, (2, 700))
    got = column(risk_styles.decayed_sums(frame(spark, {"x": x}), {"s": F.col("x")}, 1.5), "s", 2)  # seven blocks of 96 rows
    for k in range(2):
        want, s = [], 0.0
        for v in x[k]:
            s = s * 0.5 ** (1 / 1.5) + v
            want.append(s)
        assert np.allclose(got[k], want, rtol=1e-12)


def test_halflife_mean_equals_direct_sums(spark, returns):
    ret, _ = returns
    got = column(risk_styles.halflife_mean(frame(spark, {"ret": ret}), F.col("ret"), 30, 8, "m"), "m", 3)
    w = 0.5 ** (np.arange(30) / 8)
    for k in range(3):
        for t in range(300):
            x = ret[k, max(0, t - 29) : t + 1][::-1]
            known = ~np.isnan(x)
            weight = w[: len(x)][known].sum()
            if weight < 0.5 * w.sum():
                assert np.isnan(got[k][t])
            else:
                assert got[k][t] == pytest.approx((w[: len(x)][known] * x[known]).sum() / weight, abs=1e-12)


def test_market_without_movement_and_empty_panel(spark):
    flat = np.full((1, 60), 0.25)
    df = frame(spark, {"ret": np.random.default_rng(0).normal(0, 1, (1, 60)), "market": flat})
    assert df.transform(lambda d: risk_styles.market_regression(d, "ret", "market", 5, 20)).where("beta is not null and abs(beta) < 1e3").count() == 0
    assert risk_styles.market_regression(df.limit(0), "ret", "market").count() == 0
