"""Windows over arrays against the same windows as Columns."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from crosspanel.plans import expressions as e
from crosspanel.plans import factors, series

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """Three codes over 90 days: gaps, ties, a constant stretch, a short code and one without values."""
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate((90, 90, 40, 30)):
        close = np.round(np.exp(np.cumsum(rng.normal(0, 0.03, n))) * 20, 1)
        close[20:30] = close[20]
        high, low = close * (1 + np.round(rng.random(n) * 0.03, 3)), close * (1 - np.round(rng.random(n) * 0.03, 3))
        volume = np.round(rng.lognormal(8, 1, n))
        table = np.stack([close * (1 + np.round(rng.normal(0, 0.01, n), 3)), high, low, close, volume, volume * close])
        table[:, rng.random(n) < 0.12] = np.nan
        if k == 3:
            table[:] = np.nan
        rows += [(f"c{k}", DAY + datetime.timedelta(days=t), *(None if np.isnan(v) else float(v) for v in table[:, t])) for t in range(n)]
    df = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double").repartition(3)
    return df.cache()


def rows_of(df):
    return {(r["code"], r["date"]): r.asDict() for r in df.collect()}


def compare(panel, formulas, swaps=0):
    """swaps: places where ranks of values that agree up to rounding may be the other way round."""
    want, got = rows_of(e.evaluate(panel, formulas)), rows_of(e.evaluate(panel, formulas, passes=True))
    assert want.keys() == got.keys()
    wrong = [(k, n, want[k][n], got[k][n]) for k in want for n in formulas if not (want[k][n] == got[k][n] or None not in (want[k][n], got[k][n]) and got[k][n] == pytest.approx(want[k][n], rel=1e-7, abs=1e-8))]
    assert len(wrong) <= swaps, (len(wrong), sorted({w[1] for w in wrong}), wrong[:5])
    return want


def test_every_kernel(panel):
    x, y, w = e.column("close"), e.column("volume"), 7
    formulas = {f.__name__ if hasattr(f, "__name__") and f.__name__ != "<lambda>" else n: f(x, w) for n, f in vars(e).items() if n in ("ts_sum", "ts_mean", "ts_std", "ts_max", "ts_min", "ts_prod", "ts_rank", "ts_argmax", "ts_argmin", "decay_linear", "wma", "ts_slope", "ts_rsquare", "ts_resi", "delay")}
    formulas |= {n: f(x, w) for n, f in vars(e).items() if n in ("ts_sum", "ts_mean", "ts_std", "ts_max", "ts_min", "ts_prod", "ts_rank", "ts_argmax", "ts_argmin", "decay_linear", "wma", "ts_slope", "ts_rsquare", "ts_resi", "delay")}
    formulas |= {"corr": e.ts_corr(x, y, w), "cov": e.ts_cov(x, y, w), "q": e.ts_quantile(x, w, 0.3), "count": e.ts_count(x > e.delay(x, 1), w), "sma": e.ewm_sma(x, 5, 2), "nested": e.ts_mean(e.cs_rank(e.ts_std(x, 3)) * e.ts_rank(y, 4), 5), "long": e.ts_mean(x, 60), "whole": e.delay(x, 200)}
    want = compare(panel, formulas)
    used = {t.series[0] for t in formulas.values() if t.series}
    assert used >= set(e.KERNELS) - {"slope", "rsquare", "resi"} | {"slope", "rsquare", "resi"}
    for n in formulas:
        assert n == "whole" or any(r[n] is not None for r in want.values()), n


@pytest.mark.parametrize("part", range(3))
def test_bar_features(panel, part):
    names = sorted(factors.bar_features((5, 20)))[part::3]
    compare(panel, {n: factors.bar_features((5, 20))[n] for n in names})


@pytest.mark.parametrize("library", ["short_formulas", "price_volume_formulas"])
def test_samples_of_published_families(panel, library):
    known = getattr(factors, library)()
    names = sorted(known)[:: max(1, len(known) // 14)]
    compare(panel, {n: known[n] for n in names}, swaps=4)


def test_windows_of_several_series_at_once():
    # Each array was one series' before, so a task made every window of every code on its own.
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 3, 40))
    x[rng.random(x.shape) < 0.2] = np.nan
    for name, kernel in series.KERNELS.items():
        pair = name in ("corr", "cov", "slope", "rsquare", "resi")
        numbers = {"quantile": (7, 0.3), "sma": (5, 2), "delay": (3,)}.get(name, (7,))
        both = kernel(x, y, *numbers) if pair else kernel(x, *numbers)
        for k in range(3):
            one = kernel(x[k], y[k], *numbers) if pair else kernel(x[k], *numbers)
            assert np.array_equal(both[k], one, equal_nan=True), name


def test_equal_values_have_equal_sums_wherever_gaps_stand():
    x = np.round(np.random.default_rng(2).random(30) * 100, 2) + 0.1
    a, b = np.full(60, np.nan), np.full(60, np.nan)
    a[1:60:2], b[np.sort(np.random.default_rng(3).permutation(60)[:30])] = x, x
    assert series.total(a, 60, 1)[-1] == series.total(b, 60, 1)[-1]


def test_rounding_is_sparks(spark):
    from pyspark.sql import functions as F

    x = np.concatenate([np.random.default_rng(5).normal(0, 10.0 ** np.arange(-7, 13)[:, None], (20, 200)).ravel(), np.arange(-50, 50) / 128 / 16, [0.5e-6, -0.5e-6, 1.0000005, -0.0, 1e18]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert series.half_up(x, 6).tolist() == want
