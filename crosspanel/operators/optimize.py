"""Weights of a portfolio from the covariance of its codes' recent returns.

The returns of each period's holdings are gathered by Spark; a period is one group of (holdings x lookback) numbers, and periods are solved side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("ew", "score", "rank", "invvol", "mv", "rp")
LEAST_ROWS = 5


def shrunk_covariance(returns: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf's estimate: the sample covariance (over n) drawn to a multiple of the unit matrix. Unknown returns count as 0."""
    x = np.where(np.isfinite(returns), returns, 0.0)
    n, p = x.shape
    x = x - x.mean(axis=0)
    sample = x.T @ x / n
    scale = np.trace(sample) / p
    if p == 1:
        return sample
    away = ((sample - scale * np.eye(p)) ** 2).sum()  # distance of the sample from the target
    noise = ((x**2).T @ (x**2)).sum() / n**2 - (sample**2).sum() / n  # error of the sample
    share = 0.0 if away <= 0 else min(max(noise, 0.0) / away, 1.0)
    return (1 - share) * sample + share * scale * np.eye(p)


def capped(w: np.ndarray, cap: float | None) -> np.ndarray:
    """Weights that sum to 1 with none above the cap; what is cut goes to the others in proportion. Equal weights where the cap can't hold or nothing is positive."""
    w = np.where(np.isfinite(w) & (w > 0), w, 0.0)
    n = len(w)
    w = w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)
    if cap is None or not 0 < cap < 1:
        return w
    if n * cap + 1e-12 < 1:
        return np.full(n, 1 / n)
    at = np.zeros(n, bool)
    while (over := ~at & (w > cap + 1e-12)).any():
        at |= over
        left = 1 - cap * at.sum()
        free = w[~at].sum()
        w = np.where(at, cap, w * (left / free) if free > 0 else left / max(1, (~at).sum()))
    return w / w.sum()


def on_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights between 0 and the cap that sum to 1."""
    low, high = v.min() - 1.0, v.max()
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(v - (low + high) / 2, 0, cap)


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 1.0, cap: float | None = None, rounds: int = 5000) -> np.ndarray:
    """The weights with the largest mu.w - aversion / 2 * w.cov.w, long only, by accelerated projected steps."""
    n = len(mu)
    most = 1.0 if cap is None or not 0 < cap < 1 else cap
    step = 1 / max(aversion * np.linalg.eigvalsh(cov)[-1], 1e-6)
    w = y = np.full(n, 1 / n)
    t = 1.0
    for _ in range(rounds):
        new = on_simplex(y + step * (mu - aversion * cov @ y), most)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        still = np.abs(new - y).max() < 1e-13  # a step from here leads nowhere else
        y = new + (t - 1) / later * (new - w)
        w, t = new, later
        if still:
            break
    return w


def risk_parity(cov: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Weights whose shares of the portfolio's variance are equal: coordinate steps on half the variance less the logs of the weights."""
    n = len(cov)
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        before = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(x / before - 1).max() < 1e-12:
            break
    return x / x.sum()


def weigh(method: str, scores: np.ndarray, returns: np.ndarray, aversion: float = 1.0, cap: float | None = None) -> np.ndarray:
    """Weights of one portfolio; returns: (rows, codes).

    With fewer than LEAST_ROWS rows mean-variance falls back to weights by score, the others to equal ones; a solution that isn't finite falls back to one over the deviation.
    """
    n = scores.shape[0]
    known = np.isfinite(scores)
    enough = returns.shape[0] >= LEAST_ROWS
    if method == "rank":
        return capped(pd.Series(np.where(known, scores, np.nan)).rank().fillna(0.0).to_numpy(), cap)
    if method == "score" or method == "mv" and not enough:
        return capped(np.where(known, scores - scores[known].min() + 1e-8, 0.0) if known.any() else np.ones(n), cap)
    if method == "ew" or not enough:
        return capped(np.ones(n), cap)
    count = np.isfinite(returns).sum(axis=0)
    centred = np.where(np.isfinite(returns), returns, 0.0) - np.where(count > 0, np.nansum(returns, axis=0) / np.maximum(count, 1), 0.0)
    deviation = np.sqrt((np.where(np.isfinite(returns), centred, 0.0) ** 2).sum(axis=0) / np.maximum(count - 1, 1))
    inverse = capped(np.where((count > 1) & (deviation > 1e-12), 1 / np.maximum(deviation, 1e-12), 0.0), cap)
    if method == "invvol":
        return inverse
    cov = shrunk_covariance(returns)
    if method == "mv":
        spread = scores[known].std() if known.sum() >= 2 else 0.0
        mu = np.where(known, (scores - scores[known].mean()) / (spread + 1e-12), 0.0) if known.sum() >= 2 else np.zeros(n)
        w = mean_variance(mu, cov, max(aversion, 1e-6), cap) if cap is None or n * cap + 1e-12 >= 1 else np.full(n, 1 / n)
    else:
        w = risk_parity(cov) if (np.diag(cov) > 0).all() else np.full(n, np.nan)
    return capped(w, cap) if np.isfinite(w).all() else inverse


def period_weights(holdings: DataFrame, returns: DataFrame, methods: list[str], lookback: int = 60, aversion: float = 1.0, cap: float | None = None) -> DataFrame:
    """method, period, code, weight for holdings(period, code, score), from returns(code, date, ret) of the `lookback` dates up to the period's date."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    calendar = returns.select("date").distinct().withColumn("_k", F.row_number().over(Window.orderBy("date")))  # one row for each date
    periods = holdings.select("period").distinct().join(F.broadcast(calendar), F.col("date") <= F.col("period")).groupBy("period").agg(F.max("_k").alias("_last"))
    wanted = holdings.join(F.broadcast(periods), "period", "left").select("period", "code", F.col("score").cast("double").alias("score"), "_last")
    recent = returns.join(F.broadcast(calendar), "date").select("code", "_k", F.col("ret").cast("double").alias("ret"))
    rows = wanted.withColumn("_k", F.explode_outer(F.sequence(F.greatest(F.lit(1), F.col("_last") - lookback + 1), F.col("_last")))).join(recent, ["code", "_k"], "left")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        table = group.pivot_table(index="_k", columns="code", values="ret", aggfunc="first", dropna=False)
        scores = group.drop_duplicates("code").set_index("code")["score"].sort_index()
        table = table.reindex(columns=scores.index)
        parts = [pd.DataFrame({"method": m, "period": group["period"].iloc[0], "code": scores.index, "weight": weigh(m, scores.to_numpy(float), table.to_numpy(float), aversion, cap)}) for m in methods]
        return pd.concat(parts)

    kind = dict(holdings.dtypes)["period"]
    return rows.groupBy("period").applyInPandas(solve, f"method string, period {kind}, code string, weight double")
