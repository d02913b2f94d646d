"""Small cases with values worked out by hand."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import backtest, labels, portfolio, selection, signals, training, universe

DAY = datetime.date(2024, 1, 1)
days = lambda n: [DAY + datetime.timedelta(days=k) for k in range(n)]


def test_soft_labels_meet_zero_at_the_edge(spark):
    panel = spark.createDataFrame([(DAY, f"c{k:02d}", float(k)) for k in range(11)], "date date, code string, y double")
    got = {r["code"]: r for r in labels.label_modes(panel, "y").collect()}
    assert [round(got[f"c{k:02d}"]["soft_long"], 12) for k in (0, 3, 6, 8, 10)] == [-0.25, -0.125, 0.0, 0.5, 1.0]
    assert got["c05"]["top_z"] == 0 and got["c06"]["top_z"] == pytest.approx(1 / math.sqrt(10))


def test_tail_weights_are_quadratic(spark):
    rows = spark.createDataFrame([(r,) for r in (0.0, 0.25, 0.5, 0.75, 1.0)], "r double")
    got = [r["w"] for r in rows.select("r", labels.sample_weights(F.col("r"))["tail_weight"].alias("w")).orderBy("r").collect()]
    assert got == pytest.approx([1.0, 0.7, 0.6, 0.7, 1.0])


def test_risk_figures_of_a_known_path(spark):
    a, b = [1.1, 1.21, 1.089, 1.198], [1.0, 1.05, 1.05, 1.1]
    values = spark.createDataFrame([(t, d, v) for t, path in (("a", a), ("b", b)) for d, v in zip(days(4), path, strict=True)], "track string, date date, nav double")
    got = {r["track"]: r for r in portfolio.risk_metrics(values, "track", 12.0, benchmark="b").collect()}
    changes = [0.1, -0.1, 1.198 / 1.089 - 1]
    growth = 1.198 / 1.1
    mean = sum(changes) / 3
    deviation = math.sqrt(sum((x - mean) ** 2 for x in changes) / 2) * math.sqrt(12)
    annual = growth ** (12 / 3) - 1
    assert got["a"]["annual_return"] == pytest.approx(annual) and got["a"]["volatility"] == pytest.approx(deviation)
    assert got["a"]["sharpe"] == pytest.approx(annual / deviation) and got["a"]["max_drawdown"] == pytest.approx(0.1)
    assert got["a"]["calmar"] == pytest.approx(annual / 0.1) and got["a"]["win_rate"] == 0.75 and got["a"]["beat_rate"] == 0.75
    assert got["b"]["information_ratio"] is None and got["b"]["win_rate"] == 0.5


def panel_of(spark, closes):
    rows = [(code, d, c, c, 0.0 if c is None else 10.0, blocked) for code, path in closes.items() for d, (c, blocked) in zip(days(len(path)), path, strict=True)]
    return spark.createDataFrame(rows, "code string, date date, open double, close double, volume double, no_sale boolean")


def held(spark, closes, stuck=()):
    panel = panel_of(spark, closes)
    periods = backtest.hold_periods(panel.select("date").distinct(), spark.createDataFrame([(DAY,)], "date date"))
    holdings = spark.createDataFrame([(DAY, code, code in stuck) for code in closes], "period date, code string, stuck boolean")
    return backtest.daily_returns(panel, holdings, periods)


def test_bought_once_and_held(spark):
    paths = held(spark, {"a": [(90.0, False), (100.0, False), (110.0, False), (121.0, False)], "b": [(100.0, False)] * 4})
    values = [r["nav"] for r in backtest.portfolio_values(paths).orderBy("date").collect()]
    assert values == pytest.approx([1.0, 1.05, 1.105])
    assert [r["nav"] for r in backtest.portfolio_values(paths, cost=0.1).orderBy("date").collect()] == pytest.approx([0.9, 0.945, 0.9945])


def test_the_gap_of_a_suspension_counts_on_the_day_of_return(spark):
    got = held(spark, {"a": [(90.0, False), (100.0, False), (None, False), (150.0, False)]}).orderBy("date").collect()
    assert [r["ret"] for r in got] == pytest.approx([0.0, 0.0, 0.5])


def test_a_stuck_code_leaves_when_it_can(spark):
    path = [(100.0, False), (90.0, True), (80.0, True), (75.0, False), (150.0, False)]
    got = held(spark, {"a": path}, stuck={"a"}).orderBy("date").collect()
    assert [r["ret"] for r in got] == pytest.approx([0.0, 80 / 90 - 1, 75 / 80 - 1, 0.0])
    assert {r["exit_date"] for r in got} == {days(4)[3]}


def test_capped_weights_stay_within_the_cap(spark):
    rows = spark.createDataFrame([(DAY, c, w) for c, w in zip("abcd", (0.7, 0.2, 0.06, 0.04), strict=True)], "date date, code string, weight double")
    got = {r["code"]: r["weight"] for r in portfolio.capped_weights(rows, 0.4).collect()}
    assert got == pytest.approx({"a": 0.4, "b": 0.4, "c": 0.12, "d": 0.08})
    assert {r["weight"] for r in portfolio.capped_weights(rows, 0.1).collect()} == {0.25}


def test_half_sample_ratio_and_hits(spark):
    ics = spark.createDataFrame([("f", d, v) for d, v in zip(days(8), [-0.1] * 4 + [-0.05, -0.05, 0.0, -0.1], strict=True)] + [("g", d, 0.1) for d in days(7)], "factor string, date date, ic double")
    got = {r["factor"]: r["ratio"] for r in selection.early_late_ratio(ics).collect()}
    assert got["f"] == pytest.approx(0.5) and got["g"] is None
    from crosspanel.operators import ic

    assert {r["factor"]: r["win_rate"] for r in ic.ic_stats(ics, "factor").collect()}["f"] == pytest.approx(7 / 8)


def test_half_life_between_horizons(spark):
    decay = spark.createDataFrame([("f", h, v) for h, v in ((1, 0.08), (2, 0.1), (4, 0.06), (8, 0.02))] + [("g", 1, 0.1), ("g", 2, 0.09), ("h", 1, 0.1)], "factor string, horizon int, abs_ic double")
    assert {r["factor"]: r["half_life"] for r in signals.half_life(decay).collect()} == {"f": pytest.approx(5.0), "g": 2.0, "h": None}


def test_overlap_and_absent_masks(spark):
    dates = spark.createDataFrame([(d,) for d in (DAY, DAY + datetime.timedelta(5), DAY + datetime.timedelta(30))], "date date")
    assert [r["weight"] for r in training.overlap_weights(dates, 10).orderBy("date").collect()] == pytest.approx([0.75, 1.0, 1.0])
    ahead = training.overlap_weights(dates, 10, F.date_add(F.lit(DAY), 32)).orderBy("date").collect()
    assert [r["weight"] for r in ahead] == pytest.approx([0.75, 1.0, 0.6])  # eight of the last label's ten days are shared
    assert [r["weight"] for r in training.overlap_weights(dates, 0).collect()] == [1.0] * 3
    row = spark.range(1).select(universe.conjunction(None, F.lit(True)).alias("a"), universe.conjunction(F.lit(None).cast("boolean"), F.lit(True)).alias("b"), universe.conjunction(None).alias("c")).first()
    assert tuple(row) == (True, False, True)


def test_named_bands(spark):
    caps = spark.createDataFrame([(v * 1e8,) for v in (5.0, 8.0, 30.0, 50.0, 100.0, 150.0, 400.0, 600.0)], "cap double").withColumns({"amount": F.lit(1e9), "code": F.lit("a"), "date": F.monotonically_increasing_id()})
    inside = lambda name: [r["cap"] / 1e8 for r in caps.where(F.col("cap").between(*[F.lit(x) for x in universe.BANDS[name]])).orderBy("cap").collect()]
    assert inside("small") == [30, 50, 100, 150] and inside("small_mid") == [50, 100, 150] and inside("mid") == [100, 150, 400] and inside("micro") == [8, 30]
    assert inside("small_mid_wide") == [30, 50, 100, 150, 400] and inside("micro_small_100") == [5, 8, 30, 50, 100] and inside("micro_30") == inside("micro_lt30") == [5, 8, 30]
    assert caps.select(universe.cap_band("all", F.lit(None).cast("double"), F.col("amount"), 1e12).alias("m")).distinct().collect() == [(True,)]


def test_overfitting_probability_and_its_logit(spark):
    trials = [(t, f"s{k}", float(k), float(k if t < 3 else -k)) for t in range(4) for k in range(4)]
    chosen = training.overfitting(spark.createDataFrame(trials, "trial int, strategy string, inside double, outside double"))
    row = training.overfitting_probability(chosen).first()
    assert (row["trials"], row["pbo"]) == (4, 0.25) and row["logit_pbo"] == pytest.approx(math.log(1 / 3))
    sure = training.overfitting_probability(chosen.where("trial < 3")).first()
    assert sure["pbo"] == 0 and sure["logit_pbo"] == pytest.approx(math.log(1e-6 / (1 - 1e-6)))
    assert tuple(training.overfitting_probability(chosen.where("false")).first()) == (0, None, None)


def test_a_formula_with_a_recursive_mean(spark):
    import pandas as pd

    from crosspanel.plans import expressions as e

    values = [1.0, 2.0, None, 4.0, 3.0, None, None, 8.0]
    panel = spark.createDataFrame([(f"c{k}", d, None if v is None else v + k) for k in range(3) for d, v in zip(days(8), values, strict=True)], "code string, date date, close double")
    got = e.evaluate(panel, {"y": e.ewm_sma(e.ewm_sma(e.column("close"), 3, 1) * 2, 4, 2)}).orderBy("code", "date").collect()
    for k in range(3):
        want = (pd.Series(values) + k).ewm(alpha=1 / 3, adjust=False).mean() * 2
        want = want.ewm(alpha=0.5, adjust=False).mean()
        assert [r["y"] for r in got if r["code"] == f"c{k}"] == pytest.approx(want.tolist())
