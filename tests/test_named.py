"""Named factors as terms against the same as Columns, and that no frame is walked row by row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crosspanel import named_queries as queries
from crosspanel.plans import named, passes

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["price_volume", "technical"])
def test_terms_equal_columns(spark, kind):
    # Some prices are zero, and some flags set, which the tables hardly have.
    panel = queries.factor_panel(spark, DATA).withColumns({
        "ret": F.when(F.hash("code", "date") % 7 == 0, -1.0).otherwise(F.col("ret")), "low": F.when(F.hash("date") % 5 == 0, F.col("open")).otherwise(F.col("low")), "limit_up_open": F.hash("code", "date") % 11 == 0,
    })
    panel = panel.localCheckpoint()
    got = {(r["code"], r["date"]): r for r in passes.library(queries._as_numbers(panel), getattr(named, kind)()).collect()}
    columns = getattr(named, f"{kind}_columns")()
    want = panel.select("code", "date", *[x.alias(n) for n, x in columns.items()]).collect()
    assert len(got) == len(want)
    for r in want:
        for n in columns:
            a, b = got[r["code"], r["date"]][n], r[n]
            b = b * 1e6 if n == "illiquidity_20" and b is not None else b
            a = a * 1e6 if n == "illiquidity_20" and a is not None else a
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))), (n, r)


@pytest.mark.parametrize("name", ["factors_price_volume", "factors_technical", "named_normalized"])
def test_no_frame_of_many_rows(spark, name):
    plan = getattr(queries, name)(spark, DATA)._jdf.queryExecution().toString()
    assert "RowFrame, -19" not in plan and "RowFrame, -239" not in plan and "RowFrame, -25" not in plan
