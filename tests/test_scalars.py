"""Costs, texts, frequencies and index returns by hand."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from crosspanel.functions import scalars
from crosspanel.operators import backtest

DAY = datetime.date(2024, 1, 1)
day = lambda k: DAY + datetime.timedelta(days=k)


def test_costs(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([0.5, 0.0, -1.0, None])], "k int, t double")
    got = [r["c"] for r in rows.select("k", scalars.rebalance_cost(F.col("t"), 0.0003, 0.0002, 0.001, 10).alias("c")).orderBy("k").collect()]
    assert got == [pytest.approx(0.25 * 0.0005 + 0.25 * 0.0015 + 0.5 * 0.0005), 0.0, 0.0, None]
    assert rows.where("k = 0").select(scalars.rebalance_cost(F.col("t"), 0, 0, 0, 0, flat_bps=30)).first()[0] == pytest.approx(0.0015)
    assert scalars.round_trip(0.0001, 0.0, 0.0005) == pytest.approx(0.0007)
    ics = spark.createDataFrame([(0.03, 0.5), (-0.03, 0.5), (None, 0.5), (0.03, None)], "m double, t double")
    assert [r[0] for r in ics.select(scalars.ic_after_cost(F.col("m"), F.col("t"), 0.002)).collect()] == [pytest.approx(0.029), pytest.approx(-0.031), None, None]


def test_reasons_and_percentages(spark):
    reasons = spark.createDataFrame([("跌幅偏离值达7%且换手",), ("日跌幅",), ("日涨幅",), ("其它",), (None,)], "r string")
    assert [r[0] for r in reasons.select(scalars.reason_bucket(F.col("r"))).collect()] == ["turnover", "down", "up", "other", "other"]
    table = lambda xs: sorted(r["x"] for r in scalars.as_share(spark.createDataFrame([(x,) for x in xs], "x double"), "x").collect())
    assert table([15.0, 20.0, 0.5]) == pytest.approx([0.005, 0.15, 0.2]) and table([0.2, 1.4, 90.0]) == [0.2, 1.4, 90.0]


def test_frequencies():
    assert [scalars.periods_per_year(f) for f in ("W-FRI", "2W-FRI", "ME", "QE", "3D", "5D", "10D", "20D", None, "0D", "odd")] == [52, 26, 12, 4, 84, 50, 25, 12, 12, 12, 12]
    assert [scalars.periods_of_months(6, f) for f in ("W-FRI", "2W-FRI", "ME", "5D")] == [26, 13, 6, 26] and scalars.periods_of_months(0, "W-FRI") == 0
    assert [scalars.frequency_of_horizon(d) for d in (1, 3, 5, 7, 15, 20)] == ["3D", "3D", "W-FRI", "W-FRI", "2W-FRI", "ME"]


def test_index_returns_chain_neighbouring_prices_only(spark):
    index = spark.createDataFrame([(day(0), 100.0), (day(1), None), (day(2), 110.0), (day(3), 121.0), (day(4), None), (day(5), 130.0), (day(6), 143.0)], "date date, px double")
    periods = spark.createDataFrame([(day(k), day(1), day(2)) for k in (2, 3, 4, 5)] + [(day(6), day(5), day(6))] + [(day(1), day(0), day(1))], "date date, period date, executed date")
    got = {r["period"]: r["ret"] for r in backtest.index_returns(index, periods).collect()}
    # 110 over 100 (the last known), 121 over 110; the gap and the day behind it earn nothing.
    assert got == {day(1): pytest.approx(0.21), day(5): pytest.approx(0.1), day(0): None}
