"""Factors freed of controls: demeaned, regressed per date, orthogonalized; ridge scores by folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crosssection as cs
from ..functions import timeseries as ts


def residual_on(panel: DataFrame, y: str, x: str, name: str, least: int = 30) -> DataFrame:
    """Per date the residual of y on one control and a constant, among codes that have both."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    over = cs.section()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(x))
    slope, intercept = F.regr_slope(a, b).over(over), F.regr_intercept(a, b).over(over)
    enough = F.count(F.when(both, F.lit(1))).over(over) >= least
    return panel.withColumn(name, F.when(both & enough, ts.real(F.col(y) - (intercept + slope * F.col(x)))))


def nonlinear_size(panel: DataFrame, size: str, name: str = "nonlin_size", least: int = 30) -> DataFrame:
    """The square of size, freed of size."""
    return residual_on(panel.withColumn("_squared", F.col(size) * F.col(size)), "_squared", size, name, least).drop("_squared")


def wls_residuals(panel: DataFrame, factors: list[str], controls: list[str], group: str | None = None, weight: str | None = None, least: int = 30) -> DataFrame:
    """Per date the residuals of all factors on controls, a constant and dummies of the group.

    A date's cross-section is as large as the universe of codes, so one task holds it.
    """

    def solve(day: pd.DataFrame) -> pd.DataFrame:
        out = day[["date", "code"]].copy()
        x = [np.ones(len(day))] + [day[c].fillna(0.0).to_numpy(float) for c in controls]
        if group:
            x += list(pd.get_dummies(day[group].fillna("none").astype(str), drop_first=True).to_numpy(float).T)
        x = np.column_stack(x)
        w = day[weight].to_numpy(float) if weight else np.ones(len(day))
        good = np.isfinite(w) & (w > 0)
        w = np.where(good, w, np.median(w[good]) if good.any() else 1.0)
        root = np.sqrt(w / w.mean())
        for f in factors:
            y = day[f].to_numpy(float)
            use = np.isfinite(y)
            res = np.full(len(day), np.nan)
            if use.sum() >= least:
                beta = np.linalg.lstsq(x[use] * root[use, None], y[use] * root[use], rcond=None)[0]
                res[use] = y[use] - x[use] @ beta
            out[f"{f}_res"] = pd.Series(res, index=day.index).astype(object).where(np.isfinite(res), None)
        return out

    columns = ["date", "code", *factors, *controls, *([group] if group else []), *([weight] if weight else [])]
    schema = "date date, code string, " + ", ".join(f"{f}_res double" for f in factors)
    return panel.select(*dict.fromkeys(columns)).groupBy("date").applyInPandas(solve, schema)


def gram_schmidt(panel: DataFrame, factors: list[str], least: int = 30) -> DataFrame:
    """Each factor freed of those before it in the list, one after another, per date."""
    done: list[str] = []
    for f in factors:
        panel = panel.withColumn(f"{f}_orth", F.col(f))
        for basis in done:
            panel = residual_on(panel, f"{f}_orth", basis, f"{f}_orth", least)
        done.append(f"{f}_orth")
    return panel


def ridge_walk_forward(panel: DataFrame, features: list[str], label: str, train: int, gap: int, every: int, penalty: float = 1.0) -> DataFrame:
    """Scores by ridge regression, fitted for every `every`-th date on the `train` dates that end `gap` before it.

    The normal equations of each date are sums, so a fold's are sums over its dates; the rows
    themselves are read once. Each fold's solution, as many numbers as features, scores its dates.
    """
    k = len(features)
    names = ["one", *features]
    dates = panel.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)  # one row for each date
    rows = panel.join(F.broadcast(dates), "date").withColumns({"one": F.lit(1.0), **{f: F.coalesce(F.col(f), F.lit(0.0)) for f in features}})
    known = rows.where(F.col(label).isNotNull())
    products = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    daily = known.groupBy("t").agg(*products, *[F.sum(F.col(a) * F.col(label)).alias(f"y{i}") for i, a in enumerate(names)])
    fold = F.explode(F.sequence(F.lit(0), F.floor((F.lit(train + gap + every) / every)).cast("int"))).alias("back")
    spread = daily.select("*", fold).withColumn("fold", (F.ceil((F.col("t") + gap + 1) / every) + F.col("back")).cast("int")).where((F.col("t") <= F.col("fold") * every - gap - 1) & (F.col("t") > F.col("fold") * every - gap - 1 - train))
    sums = spread.groupBy("fold").agg(*[F.sum(c).alias(c) for c in daily.columns if c != "t"])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = np.array([[getattr(r, f"s{min(i, j)}_{max(i, j)}") for j in range(k + 1)] for i in range(k + 1)])
                y = np.array([getattr(r, f"y{i}") for i in range(k + 1)])
                out.append((r.fold, np.linalg.solve(a + penalty * np.diag([1e-9] + [1.0] * k), y).tolist()))
            yield pd.DataFrame(out, columns=["fold", "beta"])

    solved = sums.mapInPandas(solve, "fold int, beta array<double>")
    scored = rows.withColumn("fold", F.floor(F.col("t") / every).cast("int")).join(solved, "fold")
    score = sum((F.col(a) * F.get("beta", F.lit(i)) for i, a in enumerate(names)), F.lit(0.0))
    return scored.select("date", "code", "fold", score.alias("score"))
