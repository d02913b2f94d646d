"""The weekly panel: one shuffle for all that goes by code."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from crosspanel.functions import timeseries as ts
from crosspanel.operators import choice
from crosspanel.sources.panel import on_grid, weekly_panel


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_windows_by_code_share_the_shuffle_of_the_bars(spark):
    panel = weekly_panel(spark, "/root/testdata/sf0.001").withColumn("before", ts.delay(F.col("close"), 1))
    assert shuffles(panel) == 1


def test_grid_of_gaps_and_null_keys(spark):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=7 * k)
    bars = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), None), ("b", day(1), 3.0), (None, day(1), 9.0), ("b", None, 7.0)], "code string, date date, x double")
    want = {(c, day(k)): None for c in ("a", "b", None) for k in range(3)} | {("a", day(0)): 1.0, ("b", day(1)): 3.0}
    assert {(r["code"], r["date"]): r["x"] for r in on_grid(bars).collect()} == want


def test_importance_makes_no_row_for_each_cluster_and_turn(spark, monkeypatch):
    rows = spark.range(400).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("date"), F.col("id").cast("string").alias("code"), F.rand(1).alias("fwd"), F.rand(2).alias("a"), F.rand(3).alias("b"))
    clusters = spark.createDataFrame([("C01", "a"), ("C02", "b")], "cluster string, feature string")

    def explode(*_):
        raise AssertionError("rows are multiplied")

    monkeypatch.setattr(choice.F, "explode", explode)
    assert choice.cluster_importance(rows, {"a": 1.0, "b": 2.0}, clusters, "fwd", 20, 42, 30).count() == 2


def test_recursive_mean_walks_a_code_once(spark):
    from crosspanel import queries

    plan = queries.ewm_sma(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list(struct(x" not in plan and "Window" not in plan and shuffles(queries.ewm_sma(spark, "/root/testdata/sf0.001")) == 1
