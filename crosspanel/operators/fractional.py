"""Fractional differences of long series, and the least order that makes them stationary."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weights(d: float, threshold: float = 1e-5, most: int = 10_000) -> np.ndarray:
    """1, -d, d (d - 1) / 2, ...: the binomial series of (1 - lag)^d up to the first weight below the threshold, and no further than lag `most`."""
    lags = np.arange(1, most + 1)
    w = np.concatenate([[1.0], np.cumprod((lags - 1 - d) / lags)])
    small = np.flatnonzero(np.abs(w) < threshold)
    return w[: small[0]] if len(small) else w


def difference(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of w[k] * x[t - k]; not known where the window isn't full or has a gap. A window longer than the series is cut to it."""
    w = w[: len(x)]
    gap = ~np.isfinite(x)
    out = np.full(len(x), np.nan)
    if len(x):
        valid = np.convolve(gap, np.ones(len(w)), "valid") < 0.5
        out[len(w) - 1 :] = np.where(valid, np.convolve(np.where(gap, 0.0, x), w, "valid"), np.nan)
    return out


def fractional_difference(panel: DataFrame, value: Column, d: float, name: str, threshold: float = 1e-5, most: int = 10_000) -> DataFrame:
    """code, date and the fractional difference of order d of the value. A code's series, of the calendar's length, is one group."""
    w = weights(d, threshold, most)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        made = difference(rows["_v"].to_numpy(float), w)
        return pd.DataFrame({"code": rows["code"], "date": rows["date"], name: pd.Series(made, index=rows.index).astype(object).where(np.isfinite(made), None)})

    return panel.select("code", "date", value.cast("double").alias("_v")).groupBy("code").applyInPandas(walk, f"code string, date date, {name} double")


#: MacKinnon's polynomials for the unit-root statistic with a constant, and the statistics between which they hold.
_LOW, _SWITCH, _HIGH = -18.83, -1.61, 2.74
_SMALL, _LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(statistic: float) -> float:
    """The chance of a statistic as low as this if the series has a unit root."""
    if statistic > _HIGH:
        return 1.0
    if statistic < _LOW:
        return 0.0
    z = sum(c * statistic**i for i, c in enumerate(_SMALL if statistic <= _SWITCH else _LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _regression(x: np.ndarray, lags: int, skip: int) -> tuple[float, float]:
    """t of the level and Akaike's criterion of the regression of changes on level, `lags` earlier changes and a constant, from row `skip` on."""
    change = np.diff(x)
    y = change[skip:]
    columns = [x[skip:-1], *[change[skip - k : len(change) - k] for k in range(1, lags + 1)], np.ones(len(y))]
    a = np.column_stack(columns)
    inverse = np.linalg.pinv(a.T @ a)
    beta = inverse @ a.T @ y
    n, k = a.shape
    rest = float(((y - a @ beta) ** 2).sum())
    if rest <= 0 or n <= k:
        raise ValueError("nothing is left to explain")
    return beta[0] / math.sqrt(rest / (n - k) * inverse[0, 0]), n * (math.log(2 * math.pi) + math.log(rest / n) + 1) + 2 * k


def augmented_dickey_fuller(x: np.ndarray) -> float:
    """p value of the test with a constant; the number of lags has the least Akaike criterion over one common sample."""
    n = len(x)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    best = min(range(most + 1), key=lambda k: _regression(x, k, most)[1])
    return unit_root_p(_regression(x, best, best)[0])


def stationarity(panel: DataFrame, value: Column, orders: list[float], threshold: float = 1e-5, codes: int = 20, least: int = 30) -> DataFrame:
    """d, median_p and n of each order: the median p value of the unit-root test over the `codes` fullest codes (ties by code).

    Series of fewer than `least` differences or without two values are left out; an order without any has a null.
    """
    slim = panel.select("code", "date", value.cast("double").alias("_v"))
    fullest = slim.groupBy("code").agg(F.count("_v").alias("_n")).orderBy(F.desc("_n"), "code").limit(codes).select("code")

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("date")["_v"].to_numpy(float)
        out = []
        for d in orders:
            y = difference(x, weights(d, threshold))
            y = y[np.isfinite(y)]
            if len(y) >= least and len(np.unique(y)) >= 2:
                try:
                    out.append((d, augmented_dickey_fuller(y)))
                except ValueError:
                    continue
        return pd.DataFrame(out, columns=["d", "p"])

    tested = slim.join(F.broadcast(fullest), "code").groupBy("code").applyInPandas(test, "d double, p double")
    listed = panel.sparkSession.createDataFrame([(float(d),) for d in orders], "d double")
    return listed.join(tested, "d", "left").groupBy("d").agg(F.percentile("p", F.lit(0.5)).alias("median_p"), F.count("p").alias("n"))


def optimal_order(table: DataFrame, level: float = 0.01) -> DataFrame:
    """One row, `d`: the least order with a median p value below the level, or the largest order if there is none."""
    return table.agg(F.coalesce(F.min(F.when(F.col("median_p") < level, F.col("d"))), F.max("d")).alias("d"))
