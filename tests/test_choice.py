"""Selection by residual coefficients, linkage and importance against direct versions."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import choice, ic

DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=7 * k) for k in range(12)]
CODES = [f"c{k:02d}" for k in range(45)]


@pytest.fixture(scope="module")
def table():
    """Seven factors: a and b carry the label, a2 is nearly a, ab their sum, the rest is noise."""
    rng = np.random.default_rng(6)
    out = {}
    for d in DAYS:
        a, b, noise = rng.normal(0, 1, 45), rng.normal(0, 1, 45), rng.normal(0, 1, (3, 45))
        x = {"a": a, "a2": a + 0.05 * rng.normal(0, 1, 45), "b": b, "ab": a + b, "n0": noise[0], "n1": noise[1] + 0.2 * a, "n2": noise[2]}
        fwd = a + 0.7 * b + rng.normal(0, 5, 45)  # weak, as coefficients are held within 0.3
        x["b"] = np.where(rng.random(45) < 0.1, np.nan, x["b"])
        fwd[rng.random(45) < 0.1] = np.nan
        out[d] = pd.DataFrame(x | {"fwd": fwd}, index=CODES)
    return out


@pytest.fixture(scope="module")
def rows(spark, table):
    none = lambda v: None if np.isnan(v) else float(v)
    return spark.createDataFrame([(f, d, c, none(t.loc[c, f]), none(t.loc[c, "fwd"])) for d, t in table.items() for f in t if f != "fwd" for c in CODES], "factor string, date date, code string, x double, fwd double").cache()


def mean_and_ratio(table, f, basis, least):
    ics = []
    for t in table.values():
        x = t[f]
        if basis:
            use = t[[f, *basis]].notna().all(axis=1)
            if use.sum() < max(least, len(basis) + 5):
                continue
            a = np.column_stack([np.ones(use.sum()), t.loc[use, basis]])
            x = pd.Series(np.nan, index=t.index)
            x[use] = np.round(t.loc[use, f] - a @ np.linalg.lstsq(a, t.loc[use, f], rcond=None)[0], 9)
        # Ranks among each side's own values.
        r, y = x.rank(), t["fwd"].rank()
        both = r.notna() & y.notna()
        if both.sum() >= least:
            ics.append(np.clip(np.corrcoef(r[both], y[both])[0, 1], -0.3, 0.3))
    return (np.mean(ics), np.mean(ics) / np.std(ics) if np.std(ics) > 0 else 0.0) if ics else (np.nan, np.nan)


@pytest.mark.parametrize(("most", "batch"), [(30, 16), (30, 1), (2, 3)])
def test_selection_equals_one_candidate_after_the_other(spark, table, rows, most, batch):
    raw = {f: mean_and_ratio(table, f, [], 20) for f in ("a", "a2", "b", "ab", "n0", "n1", "n2")}
    stats = ic.ic_stats(ic.ic_series(rows, "x", "fwd", 20, ("factor", "date")), "factor")
    order = sorted([f for f, (m, r) in raw.items() if abs(m) >= 0.02 and abs(r) >= 0.2 and abs(r) * 12**0.5 >= 0.5], key=lambda f: (-abs(raw[f][1]), -abs(raw[f][0]), f))
    kept, tried = [], {}
    for f in order:
        if len(kept) == most:
            break
        m, r = mean_and_ratio(table, f, kept, 20)
        tried[f] = (m, r)
        if abs(m) > 0.015 and abs(r) > 0.15:
            kept.append(f)
    got = {r["factor"]: r for r in choice.gram_schmidt_selection(rows, stats, most, first_t=0.5, least=20, batch=batch).collect()}
    assert [f for f, r in sorted(got.items(), key=lambda x: x[1]["place"] or 99) if r["verdict"] == "kept"] == kept and len(kept) >= 2
    for f, (m, r) in tried.items():
        if np.isnan(m):  # nothing is left of it
            assert got[f]["ic_mean"] is None and got[f]["verdict"] == "redundant"
        else:
            assert got[f]["ic_mean"] == pytest.approx(m, abs=1e-9) and got[f]["icir"] == pytest.approx(r, abs=1e-7)
    assert {f for f, r in got.items() if r["verdict"] == "weak"} == set(raw) - set(order)
    assert {f for f, r in got.items() if r["verdict"] == "full"} == set(order) - set(tried)


def test_average_linkage_by_hand():
    d = 1 - np.array([[1, 0.9, 0.75, 0], [0.9, 1, 0.6, 0], [0.75, 0.6, 1, 0.2], [0, 0, 0.2, 1.0]])
    # c joins {a, b} at the mean distance 0.325.
    assert choice.average_linkage(list("abcd"), d, 0.3) == [["a", "b"], ["c"], ["d"]]
    assert choice.average_linkage(list("abcd"), d, 0.33) == [["a", "b", "c"], ["d"]]
    assert choice.average_linkage(list("abcd"), d, 1.0) == [["a", "b", "c", "d"]] and choice.average_linkage(["a"], np.zeros((1, 1)), 0.3) == [["a"]]


def test_clusters_and_what_a_score_loses_without_them(spark, table):
    wide = pd.concat([t.assign(date=d, code=t.index) for d, t in table.items()])
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in wide[["date", "code", "a", "a2", "b", "n0", "fwd"]].itertuples(index=False)], "date date, code string, a double, a2 double, b double, n0 double, fwd double").repartition(3)
    corr = {(r["a"], r["b"]): r["corr"] for r in choice.feature_correlations(df, ["a", "a2", "b", "n0"]).collect()}
    want = wide[["a", "a2", "b", "n0"]].corr()
    assert len(corr) == 6 and all(v == pytest.approx(want.loc[k]) for k, v in corr.items())
    clusters = choice.clustered_features(df, ["n0", "b", "a2", "a"])
    assert sorted(tuple(r) for r in clusters.collect()) == [("C01", "a"), ("C01", "a2"), ("C02", "b"), ("C03", "n0")]
    betas = {"a": 0.5, "a2": 0.5, "b": 0.7}
    got = {r["cluster"]: r for r in choice.cluster_importance(df, betas, clusters, "fwd", 5, 1, 20).collect()}
    assert got["C01"]["importance"] > 0.02 and got["C02"]["importance"] > 0.02 and got["C03"]["importance"] == pytest.approx(0, abs=1e-12)
    assert [got[c]["n_features"] for c in sorted(got)] == [2, 1, 0]
    again = {r["cluster"]: r["importance"] for r in choice.cluster_importance(df.repartition(2), betas, clusters, "fwd", 5, 1, 20).collect()}
    assert all(again[c] == pytest.approx(got[c]["importance"], abs=1e-12) for c in got)
    # If nothing else is in the score, its coefficient falls to about nothing.
    alone = choice.cluster_importance(df, {"a": 1.0}, clusters, "fwd", 8, 3, 20).where("cluster = 'C01'").first()["importance"]
    base = ic.ic_series(df.where(F.col("fwd").isNotNull()), "a", "fwd", 20).agg(F.avg("ic")).first()[0]
    assert alone == pytest.approx(base, abs=0.12)
