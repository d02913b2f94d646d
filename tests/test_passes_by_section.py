"""Styles and section ranks are made from arrays of one code's or one date's rows."""

from __future__ import annotations

import numpy as np

from crosspanel import catalogue
from crosspanel.plans import series

DATA = "/root/testdata/sf0.001"


def test_styles_walk_no_frames_and_no_quantile_maps(spark):
    plan = catalogue.QUERIES["risk_style_factors"](spark, DATA)._jdf.queryExecution().toString()
    assert "RowFrame, -251" not in plan and "RowFrame, -62" not in plan and "percentile" not in plan


def test_section_ranks_need_no_quantile_maps(spark):
    plan = catalogue.QUERIES["cs_rank_z"](spark, DATA)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "Window" not in plan


def test_section_functions():
    x = np.array([3.0, np.nan, 1.0, 2.0, 100.0])
    assert np.allclose(series.winsorized(x, 0.25), [3, np.nan, 1.75, 2, 27.25], equal_nan=True)
    z = series.zscored(x)
    assert np.isnan(z[1]) and abs(np.nanmean(z)) < 1e-12 and abs(np.nanstd(z) - 1) < 1e-12
    assert np.isnan(series.zscored(np.full(3, 0.1))).all() and np.isnan(series.winsorized(np.full(2, np.nan), 0.1)).all()


def _reads(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("l_suppkey")


def test_panels_are_made_once(spark):
    # What is left of each plan reads stored tables; lines were read again for every statistic.
    for name in ("dynamic_score", "factor_tracks", "trigger_payoff_summary", "two_stage_scores"):
        assert _reads(catalogue.QUERIES[name](spark, DATA)) == 0, name
