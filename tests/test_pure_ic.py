"""Pure coefficients against a direct least-squares regression with dummies."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import pure_ic

SCHEMA = "factor string, date date, code string, x double, fwd double, a double, b double, g string, w double"
DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(4)]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    rows = []
    for f in ("f", "h"):
        for d in DAYS:
            for k in range(60):
                a, b = rng.normal(), rng.normal()
                group = None if k % 13 == 0 else f"g{k % 4}" if k != 7 else "alone"
                x = a - 2 * b + (k % 4) + rng.normal() * 0.5
                rows.append((f, d, f"c{k:02d}", None if k % 11 == 0 else x, None if k % 17 == 0 else rng.normal() + 0.3 * x, None if k == 5 else a, b, group, None if k % 9 == 0 else float(rng.uniform(0, 4)) if k % 8 else -1.0))
    return rows


def clean(rows):
    return [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in rows]


def direct(rows, least=30):
    """Section by section: normalised weights, dummies, lstsq, ranks."""
    out, res_of = {}, {}
    df = pd.DataFrame(rows, columns=["factor", "date", "code", "x", "fwd", "a", "b", "g", "w"])
    for key, s in df.groupby(["factor", "date"]):
        s = s[s.x.notna() & s.fwd.notna()]
        if len(s) < least:
            continue
        w = s.w.where(s.w > 0)
        w = w.fillna(w.median()).to_numpy()
        design = np.column_stack([np.ones(len(s)), s.a.fillna(0), s.b.fillna(0), pd.get_dummies(s.g.fillna("none"), drop_first=True).to_numpy(float)])
        root = np.sqrt(w / w.mean())
        beta = np.linalg.lstsq(design * root[:, None], s.x.to_numpy() * root, rcond=None)[0]
        res = s.x.to_numpy() - design @ beta
        res_of.update({(*key, c): r for c, r in zip(s.code, res, strict=True)})
        out[key] = np.corrcoef(pd.Series(np.round(res, 9)).rank(), s.fwd.rank())[0, 1]
    return out, res_of


def test_residuals_and_coefficients_equal_a_direct_regression(spark, table):
    df = spark.createDataFrame(clean(table), SCHEMA)
    want, res_of = direct(table)
    got = {(r["factor"], r["date"]): r["ic"] for r in pure_ic.pure_ic(df, "x", "fwd", ["a", "b"], "g", "w").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    res = {(r["factor"], r["date"], r["code"]): r["x_res"] for r in pure_ic.residuals(df.where("fwd is not null"), ["x"], ["a", "b"], "g", "w").collect()}
    assert res.keys() == res_of.keys() and all(res[k] == pytest.approx(v, abs=1e-9) for k, v in res_of.items())
    means = {r["factor"]: (r["pure_ic"], r["n"]) for r in pure_ic.pure_means(pure_ic.pure_ic(df, "x", "fwd", ["a", "b"], "g", "w")).collect()}
    assert means["f"][0] == pytest.approx(np.mean([v for k, v in want.items() if k[0] == "f"])) and means["f"][1] == 4


def test_controls_that_depend_on_each_other_change_nothing(spark, table):
    df = spark.createDataFrame(clean(table), SCHEMA).withColumns({"twice": F.col("a") * 2, "flat": F.lit(3.0)})
    one = sorted(pure_ic.pure_ic(df, "x", "fwd", ["a"], "g").collect())
    three = sorted(pure_ic.pure_ic(df, "x", "fwd", ["a", "twice", "flat"], "g").collect())
    assert [r["ic"] for r in three] == pytest.approx([r["ic"] for r in one], abs=1e-9) and len(one) == 8
    assert pure_ic.pure_ic(df, "x", "fwd", [], None).count() == 8  # a constant alone
    assert pure_ic.pure_ic(df, "x", "fwd", ["a"], "g", least=61).count() == 0
    assert pure_ic.pure_ic(df.limit(0), "x", "fwd", ["a"], "g").count() == 0


def test_a_factor_made_of_controls_has_no_residual(spark, table):
    df = spark.createDataFrame(clean(table), SCHEMA).withColumn("x", F.coalesce(F.col("a"), F.lit(0.0)) * 3 + F.length(F.coalesce("g", F.lit("none"))))
    assert pure_ic.residuals(df, ["x"], ["a"], "g", "w").select(F.max(F.abs("x_res"))).first()[0] < 1e-9


def test_rare_groups(spark):
    rows = [(DAYS[0], c, g) for c, g in zip("abcdefg", ["x", "x", "x", "y", "z", None, None], strict=True)]
    df = spark.createDataFrame(rows, "date date, code string, g string")
    got = lambda least: [r["g"] for r in pure_ic.collapsed_groups(df, "g", least).orderBy("code").collect()]
    assert got(3) == ["x"] * 3 + ["other"] * 4 and got(2) == ["x"] * 3 + ["other"] * 2 + ["none"] * 2 and got(1) == ["x"] * 3 + ["y", "z", "none", "none"]


def test_size_within_a_pool(spark):
    rows = [(d, c, v, m) for d, cells in zip(DAYS, ([1.0, 10.0, 100.0, 5.0], [7.0, 7.0, 7.0, 1.0], [3.0, None, -1.0, 2.0]), strict=False) for c, v, m in zip("abcd", cells, [True, True, True, None], strict=True)]
    df = spark.createDataFrame(rows, "date date, code string, cap double, member boolean")
    got = {(r["date"], r["code"]): r["size"] for r in pure_ic.pool_size(df, "cap", F.col("member")).collect()}
    third = 1.5**0.5
    assert [got[DAYS[0], k] for k in "abc"] == pytest.approx([-third, 0, third]) and [got[DAYS[1], k] for k in "abc"] == [0, 0, 0]
    assert [got[DAYS[2], k] for k in "abc"] == [None] * 3 and len(got) == 9  # one known size is too few


def test_runs_are_merged_by_factor(spark):
    schema = "factor string, date date, ic double"
    old = spark.createDataFrame([("A", DAYS[0], 0.02), ("B", DAYS[0], 0.01), ("B", DAYS[1], 0.03)], schema)
    new = spark.createDataFrame([("C", DAYS[0], 0.03), ("B", DAYS[2], 0.011)], schema)
    assert sorted(tuple(r) for r in pure_ic.merged(old, new).collect()) == [("A", DAYS[0], 0.02), ("B", DAYS[2], 0.011), ("C", DAYS[0], 0.03)]
    assert sorted(pure_ic.merged(old, new.limit(0)).collect()) == sorted(old.collect()) and pure_ic.merged(old.limit(0), new).count() == 2
    wanted = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "factor string")
    series = spark.createDataFrame([("A", DAYS[0], 0.1), ("C", DAYS[0], None)], schema)
    assert sorted(r[0] for r in pure_ic.missing_names(wanted, series).collect()) == ["B", "C", "D"]


def test_spread_is_turned_to_the_mean_coefficients_side(spark, table):
    df = spark.createDataFrame(clean(table), SCHEMA)
    up = sorted(pure_ic.pure_spread(df, "x", "fwd", ["a", "b"], "g", "w").collect())
    down = sorted(pure_ic.pure_spread(df.withColumn("x", -F.col("x")), "x", "fwd", ["a", "b"], "g", "w").collect())
    assert {r["sign"] for r in up} == {1} and {r["sign"] for r in down} == {-1}
    assert [r["spread"] for r in down] == pytest.approx([r["spread"] for r in up], abs=1e-9)
    assert all(r["spread"] == pytest.approx(r["long_excess"] + r["short_contribution"]) for r in up)


def test_a_section_is_shuffled_once_and_no_factor_is_one_group(spark, table):
    """A join by factor alone would send all rows of a factor to one task."""
    rows = spark.createDataFrame(clean(table), SCHEMA)
    plan = pure_ic.pure_spread(rows, "x", "fwd", ["a", "b"], "g", "w", 5, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange hashpartitioning(factor") == 2 and "Join" not in plan
