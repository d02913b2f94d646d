from __future__ import annotations

import datetime
import math
import random
from collections import defaultdict

import pytest

from crosspanel.operators import portfolio

COLUMNS = ["track", "date", "code", "score", "can_buy", "can_sell", "ret"]
SCHEMA = "track string, date date, code string, score double, can_buy boolean, can_sell boolean, ret double"


def brute(rows, n, limit):
    """(held, bought, sold, ret) of each track and date, walked row by row."""
    days = defaultdict(lambda: defaultdict(list))
    for r in rows:
        days[r[0]][r[1]].append(dict(zip(COLUMNS, r)))
    out = {}
    for track, of in days.items():
        held = set()
        for date in sorted(of):
            scored = sorted((r for r in of[date] if r["score"] is not None and not math.isnan(r["score"])), key=lambda r: (-r["score"], r["code"]))
            target = [r["code"] for r in scored if r["can_buy"] or r["code"] in held][:n]
            leaving, new = [], []
            if target:
                leaving = [r["code"] for r in scored[::-1] if r["code"] in held and r["code"] not in target and r["can_sell"]]
                leaving = leaving[: math.floor(limit * n)]
                kept = held - set(leaving)
                new = [c for c in target if c not in kept][: max(0, n - len(kept))]
                held = kept | set(new)
            ret = [r["ret"] for r in of[date] if r["code"] in held and r["ret"] is not None and not math.isnan(r["ret"])]
            out[track, date] = len(held), len(new), len(leaving), sum(ret) / len(ret) if ret else 0.0
    return out


def case(tracks=3, periods=25, codes=40):
    rng = random.Random(6)
    rows = []
    for t in range(tracks):
        for p in range(periods):
            for k in range(codes):
                if rng.random() < 0.1:
                    continue
                shut = p in (7, 8) or (t == 1 and p < 2)  # periods without a score, or none that can be bought
                score = None if p == 7 else rng.choice([None, math.nan, *[round(rng.random(), 1)] * 8])
                rows.append((f"track {t}" if t else None, datetime.date(2024, 1, 1) + datetime.timedelta(7 * p), f"{k:06}", score, not shut and rng.random() < 0.7, rng.random() < 0.7, rng.choice([None, math.nan, rng.random() - 0.5])))
    return rows


@pytest.mark.parametrize("limit", [0.3, 1.0])
def test_constrained_track_matches_a_walk(spark, limit):
    rows = case()
    want = brute(rows, 6, limit)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # dates go over several batches
    try:
        got = portfolio.constrained_track(spark.createDataFrame(rows, SCHEMA).repartition(3), 6, limit).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r["track"], r["date"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert (r["held"], r["bought"], r["sold"], r["ret"]) == pytest.approx(want[r["track"], r["date"]]), r


def test_a_track_is_never_one_group_of_a_task(spark):
    plan = portfolio.constrained_track(spark.createDataFrame(case(1, 3, 5), SCHEMA), 2)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
