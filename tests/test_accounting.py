"""Accounting figures by hand and by brute force over what was known at each time."""

from __future__ import annotations

import datetime
import random

import pytest

from crosspanel.operators import accounting

D = datetime.date
SCHEMA = "code string, report_date date, available date, v double"
ENDS = [D(y, m, d) for y in (2020, 2021, 2022) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]


def rows_of(spark, reports):
    return {(r["code"], r["available"]): r for r in accounting.figures(spark.createDataFrame(reports, SCHEMA), ["v"]).collect()}


def test_a_year_and_a_half_by_hand(spark):
    day = lambda k: ENDS[k] + datetime.timedelta(days=40)
    cumulative = [10.0, 30.0, 60.0, 100.0, 20.0, 50.0]
    got = rows_of(spark, [("a", ENDS[k], day(k), v) for k, v in enumerate(cumulative)])
    at = lambda k: tuple(got["a", day(k)][n] for n in ("v_ttm", "v_quarter", "v_growth"))
    assert at(0) == (None, 10.0, None) and at(1) == (None, 20.0, None) and at(3) == (100.0, 40.0, None)
    assert at(4) == (110.0, 20.0, 1.0) and at(5) == (50 + 100 - 30, 30.0, pytest.approx(20 / 30))


def test_restatements_count_from_their_own_date(spark):
    reports = [("a", ENDS[k], ENDS[k] + datetime.timedelta(days=40), v) for k, v in enumerate([10.0, 30.0, 60.0, 100.0, 20.0])]
    reports += [("a", ENDS[3], D(2021, 6, 1), 90.0), ("a", ENDS[1], D(2021, 6, 5), 31.0), ("a", ENDS[4], D(2021, 7, 1), 22.0)]
    got = rows_of(spark, reports)
    assert got["a", D(2021, 5, 10)]["v_ttm"] == 110.0 and got["a", D(2021, 6, 1)]["v_ttm"] == 100.0 and got["a", D(2021, 7, 1)]["v_ttm"] == 102.0
    assert ("a", D(2021, 6, 5)) not in got  # the second quarter of last year is in no figure of the newest quarter


def by_brute_force(reports):
    out = {}
    for code in {r[0] for r in reports if r[0]}:
        mine = [r for r in reports if r[0] == code and r[1] and r[2]]
        previous = None
        for t in sorted({r[2] for r in mine}):
            known = {}
            for _, period, available, v in sorted((r for r in mine if r[2] <= t and r[3] is not None), key=lambda r: (r[2], r[3])):
                known[period.year * 4 + (period.month - 1) // 3] = v
            if not known:
                continue
            q = max(known)
            get = lambda k, known=known: known.get(k)
            now, before, ago, annual = get(q), get(q - 1), get(q - 4), get(q // 4 * 4 - 1)
            state = (q, now, ago, annual if q % 4 != 3 else ago, before if q % 4 else None)
            touched = any(r[2] == t and r[1].year * 4 + (r[1].month - 1) // 3 in {q, q - 4, q // 4 * 4 - 1, *({q - 1} if q % 4 else ())} for r in mine if r[3] is not None)
            if touched or state != previous:
                ttm = now if q % 4 == 3 else None if None in (annual, ago) else now + annual - ago
                single = now if q % 4 == 0 else None if before is None else now - before
                out[code, t] = (q, ttm, single, None if ago is None or abs(ago) <= 1e-12 else (now - ago) / abs(ago))
            previous = state
    return out


def test_random_reports_equal_brute_force(spark):
    rng = random.Random(3)
    reports = []
    for code in "abcd":
        for end in ENDS:
            if rng.random() < 0.15:
                continue
            for k in range(rng.choice([1, 1, 2, 3])):
                reports.append((code, end, end + datetime.timedelta(days=rng.randint(20, 120) + 150 * k), rng.choice([None, 0.0]) if rng.random() < 0.05 else round(rng.uniform(-50, 100), 1)))
    reports += [("a", None, D(2021, 1, 1), 1.0), (None, ENDS[0], D(2021, 1, 1), 1.0), ("a", ENDS[0], None, 1.0)]
    want, got = by_brute_force(reports), rows_of(spark, reports)
    for key, (q, *figures) in want.items():
        r = got[key]
        assert r["quarter"] == q
        for name, v in zip(("v_ttm", "v_quarter", "v_growth"), figures, strict=True):
            assert (r[name] is None) == (v is None) and (v is None or r[name] == pytest.approx(v))
    assert got.keys() == want.keys()
    assert accounting.figures(spark.createDataFrame([], SCHEMA), ["v"]).count() == 0
