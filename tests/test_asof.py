from __future__ import annotations

import datetime
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from crosspanel import catalogue as queries
from crosspanel.operators import asof

from .test_queries import DATA

DAY = datetime.timedelta(days=1)


def read(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns)).to_pylist()


def test_interval_flag_matches_brute_force(spark):
    rng = random.Random(4)
    first = datetime.date(2024, 1, 1)
    panel = [(code, first + k * DAY) for code in ("a", "b", "c", None) for k in range(0, 60, 3)] + [("a", first), ("a", None)]
    intervals = []
    for _ in range(12):
        start = first + rng.randrange(-5, 60) * DAY
        intervals.append((rng.choice("abd"), start, rng.choice([start + rng.randrange(-2, 9) * DAY] * 9 + [None])))
    intervals += [(None, first, None), ("c", None, None), ("b", first + 50 * DAY, None)]
    out = asof.interval_flag(spark.createDataFrame(panel, "code string, date date"), spark.createDataFrame(intervals, "code string, start_date date, end_date date"), "hit")
    want = Counter((c, d, any(c is not None and c == i and d is not None and s is not None and s <= d and (e is None or d <= e) for i, s, e in intervals)) for c, d in panel)
    assert out.columns == ["code", "date", "hit"] and Counter(map(tuple, out.collect())) == want


def test_interval_flag_takes_every_line(spark):
    lines = defaultdict(list)
    for r in read("lineitem", "l_suppkey", "l_shipdate", "l_linenumber"):
        lines[f"{r['l_suppkey']:06}"].append((r["l_shipdate"].date(), 7 * r["l_linenumber"]))
    rows = queries.QUERIES["interval_flag"](spark, DATA).collect()
    assert {r["code"] for r in rows} == set(lines)
    for r in rows:
        last = max(s for s, _ in lines[r["code"]])
        assert r["flagged"] == any(s <= r["date"] and (s == last or r["date"] <= s + k * DAY) for s, k in lines[r["code"]]), r


def test_events_roll_forward_or_are_dropped(spark):
    first = datetime.date(2024, 2, 1)
    grid = spark.createDataFrame([(code, first + k * DAY) for code in "ab" for k in (0, 3, 6)], "code string, date date")
    events = spark.createDataFrame([("a", first + k * DAY) for k in (-1, 0, 1, 2, 3, 3, 6)] + [("b", first + 4 * DAY)], "code string, date date")
    counts = lambda roll: {(r["code"], (r["date"] - first).days): r["n"] for r in asof.events_on_grid(grid, events, F.count("*"), "n", roll).collect()}
    assert counts(True) == {("a", 0): 2, ("a", 3): 4, ("a", 6): 1, ("b", 0): None, ("b", 3): None, ("b", 6): 1}
    assert counts(False) == {("a", 0): 1, ("a", 3): 2, ("a", 6): 1, ("b", 0): None, ("b", 3): None, ("b", 6): None}


def test_event_grid_counts_every_event_once(spark):
    rows = queries.QUERIES["event_grid"](spark, DATA).collect()
    events = read("events", "user_id", "value")
    assert sum(r["n"] or 0 for r in rows) == len(events)
    assert abs(sum(r["v"] or 0 for r in rows) - sum(e["value"] for e in events)) < 1e-6 * len(events)


def test_event_grid_spans_the_table(spark, tmp_path):
    at = [datetime.datetime(2023, 12, 30, 5), datetime.datetime(2024, 1, 3, 23), datetime.datetime(2024, 2, 9, 1)]
    spark.createDataFrame([(1, at[0], 1.0), (2, at[1], 2.0), (1, at[2], 4.0)], "user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = queries.QUERIES["event_grid"](spark, str(tmp_path)).where("n > 0").collect()
    assert sorted((r["code"], str(r["date"]), r["n"], r["v"]) for r in rows) == [("1", "2023-12-30", 1, 1.0), ("1", "2024-02-10", 1, 4.0), ("2", "2024-01-05", 1, 2.0)]
