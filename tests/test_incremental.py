"""Panels that grow, as batches and on streams."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from crosspanel.functions import timeseries as ts
from crosspanel.streaming import incremental, windows

DAY = datetime.date(2024, 1, 1)
day = lambda k: DAY + datetime.timedelta(days=k)
SCHEMA = "code string, date date, a double, b double"


def table(spark, rows):
    return spark.createDataFrame([(c, day(k), a, b) for c, k, a, b in rows], SCHEMA)


def cells(df):
    return {(r["code"], (r["date"] - DAY).days): (r["a"], r["b"]) for r in df.collect()}


def test_nothing_known_is_destroyed(spark):
    old = table(spark, [("x", 0, 1.0, 2.0), ("x", 1, 3.0, None), ("y", 0, 5.0, 6.0)])
    new = table(spark, [("x", 1, None, 9.0), ("x", 2, 7.0, 7.0), ("y", 0, 50.0, None), ("z", 1, 8.0, None)])
    want = {("x", 0): (1, 2), ("x", 1): (3, 9), ("y", 0): (50, 6), ("x", 2): (7, 7), ("z", 1): (8, None)}
    once = incremental.merged(old, new, ["a", "b"])
    assert cells(once) == want and cells(incremental.merged(once, new, ["a", "b"])) == want
    assert cells(incremental.merged(old, new, ["a", "b"], new_codes_only=True)) == cells(old) | {("z", 1): (8, None)}
    assert cells(incremental.merged(old.limit(0), new, ["a", "b"])) == cells(new) and cells(incremental.merged(old, new.limit(0), ["a", "b"])) == cells(old)


def test_factors_of_later_dates_need_a_bounded_look_back(spark):
    panel = spark.createDataFrame([(c, day(k), float((k * 7 + i * 3) % 11) if (k + i) % 5 else None) for i, c in enumerate("xyz") for k in range(40)], "code string, date date, close double")
    read = []

    def compute(p):
        read.append(p.select("date").distinct().count())
        return p.select("code", "date", ts.ts_mean(F.col("close"), 6).alias("a"), ts.delay(F.col("close"), 3).alias("b"))

    whole = cells(compute(panel))
    part = compute(panel.where(F.col("date") < day(25)))
    read.clear()
    assert cells(incremental.appended(part, panel, ["a", "b"], 6, compute)) == whole and read == [15 + 6]
    assert cells(incremental.appended(part.limit(0), panel, ["a", "b"], 6, compute)) == whole
    # No later date: the last one is made again, known cells only.
    bad = part.withColumns({"a": F.when(F.col("date") == day(24), -1.0).otherwise(F.col("a")), "b": F.when(F.col("date") == day(24), -1.0).otherwise(F.col("b"))})
    mended = cells(incremental.appended(bad, panel.where(F.col("date") < day(25)), ["a", "b"], 6, compute))
    assert mended == {k: tuple(-1.0 if v is None and k[1] == 24 else v for v in whole[k]) for k in mended} and len(mended) == 75


def test_a_stream_of_batches_with_one_run_twice(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    steps = [[("x", 0, 1.0, 2.0), ("y", 0, 3.0, None)], [("x", 0, None, 4.0), ("x", 1, 5.0, None)], [("y", 0, 6.0, 7.0)]]
    write = incremental.batch_writer(sink)
    for rows in steps:
        table(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = {("x", 0): (1, 4), ("x", 1): (5, None), ("y", 0): (6, 7)}
    assert cells(incremental.current(spark, sink, ["a", "b"])) == want
    write(table(spark, steps[1]), 1)
    assert cells(incremental.current(spark, sink, ["a", "b"])) == want
    packed = str(tmp_path / "packed")
    assert cells(incremental.compacted(spark, sink, packed, ["a", "b"])) == want
    incremental.batch_writer(packed)(table(spark, [("x", 1, None, 8.0)]), 0)
    assert cells(incremental.current(spark, packed, ["a", "b"])) == want | {("x", 1): (5, 8)}


def test_upsert_keeps_the_last_of_each_key_and_bears_repetition(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, at int, v double"
    for rows in ([("a", 1, 1.0), ("b", 1, 2.0)], [("a", 2, 3.0), ("c", 1, 4.0), ("b", 0, 9.0)], [("a", 2, 3.0), ("c", 1, 4.0), ("b", 0, 9.0)]):
        windows.upsert(spark.createDataFrame(rows, schema), path, ["k"], "at")
    assert sorted(tuple(r) for r in windows.latest(spark, path)[1].collect()) == [("a", 2, 3.0), ("b", 1, 2.0), ("c", 1, 4.0)]


def test_hours_on_a_stream_close_after_the_watermark(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    batches = [[(at(0, 5), "v", 1.0), (at(0, 50), "v", 2.5), (at(1, 1), "w", 1.0)], [(at(0, 58), "v", 4.0), (at(2, 30), "v", 1.0)], [(at(0, 1), "v", 100.0), (at(5, 0), "v", 1.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(source)
        stream = windows.hourly(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(source))
        stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["event_type"], r["hour"].hour): (r["n"], r["total"]) for r in spark.read.parquet(sink).collect()}
    # 0:58 came in time, 0:01 after its hour was closed.
    assert got == {("v", 0): (3, 7.5), ("w", 1): (1, 1.0), ("v", 2): (1, 1.0)}
