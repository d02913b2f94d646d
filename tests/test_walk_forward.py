"""Walk-forward scores against a regression date by date."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import walk_forward as wf

DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=7 * k) for k in range(20)]
STATES = ["up", "up", "down", None] * 5


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(2)
    rows = []
    for d in DAYS:
        for k in range(60):
            a, b = rng.normal(0, 1, 2)
            rows.append((d, f"c{k:02d}", a if rng.random() > 0.1 else np.nan, b, (a - 0.5 * b + rng.normal(0, 1)) if rng.random() > 0.1 else np.nan, rng.normal() + a if rng.random() > 0.05 else np.nan))
    return pd.DataFrame(rows, columns=["date", "code", "a", "b", "y", "s1"])


@pytest.fixture(scope="module")
def panel(spark, table):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in table.itertuples(index=False)], "date date, code string, a double, b double, y double, s1 double").repartition(3).cache()


def ridge(train, rows, penalty):
    x = lambda t: np.column_stack([np.ones(len(t)), t.a.fillna(0), t.b.fillna(0)])
    train = train[train.y.notna()]
    beta = np.linalg.solve(x(train).T @ x(train) + penalty * np.diag([0, 1, 1]), x(train).T @ train.y)
    return dict(zip(rows.code, x(rows) @ beta, strict=True))


def train_of(i, lookback, gap, states=None, least=4):
    past = list(range(max(0, i - gap - lookback), max(0, i - gap)))
    if len(past) < least:
        return []
    own = [k for k in past if states and states[k] is not None and states[k] == states[i]]
    return own if len(own) >= least else past


@pytest.mark.parametrize("states", [None, STATES])
def test_scores_equal_a_regression_date_by_date(spark, table, panel, states):
    dates = spark.createDataFrame([(d, s) for d, s in zip(DAYS, STATES, strict=True)], "date date, state string")
    folds = wf.training_dates(dates, 10, 2, "state" if states else None)
    pairs = {}
    for r in folds.collect():
        pairs.setdefault(r["date"], set()).add(r["train"])
    assert pairs == {d: {DAYS[k] for k in t} for i, d in enumerate(DAYS) if (t := train_of(i, 10, 2, states))}
    got = {(r["date"], r["code"]): r["score"] for r in wf.ridge_scores(panel, ["a", "b"], "y", folds, 3.0).collect()}
    want = {(d, c): v for i, d in enumerate(DAYS) if (t := train_of(i, 10, 2, states)) for c, v in ridge(table[table.date.isin([DAYS[k] for k in t])], table[table.date == d], 3.0).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert wf.ridge_scores(panel, ["a", "b"], "y", folds, 3.0, least_rows=10_000).count() == 0


def test_second_stage_within_the_first_ones_pool(table, panel):
    got = {(r["date"], r["code"]): (r["in_pool"], r["score"]) for r in wf.two_stage(panel, "s1", ["a", "b"], "y", 6, 1, 0.5, 60, 20, 2.0).collect()}
    pools = {}
    for d, t in table[table.s1.notna()].groupby("date"):
        best = t.sort_values(["s1", "code"], ascending=[False, True]).head(int(len(t) * 0.5)).copy()
        for c in ("a", "b", "y"):
            v = best[c].clip(best[c].quantile(0.01), best[c].quantile(0.99))
            best[c] = (v - v.mean()) / v.std(ddof=0)
        pools[d] = best
    want = {}
    for i, d in enumerate(DAYS):
        t = train_of(i, 6, 1)
        if t and sum(pools[DAYS[k]].y.notna().sum() for k in t) >= 60:
            second = ridge(pd.concat([pools[DAYS[k]] for k in t]), pools[d], 2.0)
            want.update({(d, c): (c in second, second.get(c, -np.inf)) for c in table[(table.date == d) & table.s1.notna()].code})
    assert got.keys() == want.keys() and len(want) > 500
    assert all(got[k][0] == v[0] and got[k][1] == pytest.approx(v[1], abs=1e-9) for k, v in want.items())
    assert wf.two_stage(panel, "s1", ["a", "b"], "y", 6, 1, 0.5, 60, 59).count() == 0


def test_features_of_the_pool_in_force(spark):
    rows = spark.createDataFrame([(f, d, c, float(k)) for k, (f, d, c) in enumerate((f, d, c) for f in "xyz" for d in DAYS[:5] for c in ("p", "q"))], "factor string, date date, code string, x double")
    schedule = spark.createDataFrame([(DAYS[1], "x"), (DAYS[1], "y"), (DAYS[3], "z")], "date date, factor string")
    got = {(r["date"], r["code"]): (r["x"] is not None, r["y"] is not None, r["z"] is not None) for r in wf.feature_table(rows, schedule, ["x", "y", "z"]).collect()}
    assert got == {(d, c): (True, True, False) if k < 3 else (False, False, True) for k, d in enumerate(DAYS[:5]) if k >= 1 for c in ("p", "q")}
    assert wf.pooled_rows(rows, schedule.limit(0)).count() == 0
    assert wf.pooled_rows(rows, schedule).where(F.col("date") == DAYS[2]).count() == 4
