"""Named factors of prices, volumes, limits, size and industry, as columns of a panel.

A panel here has open, high, low, close, volume, amount, ret (null on limit days), the limit flags, industry and cap. Values are raw;
`normalized` gives the form in which factors are compared: clipped at quantiles of the date, standardised, clipped at three deviations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crosssection as cs
from ..functions import timeseries as ts
from . import expressions as e
from .expressions import Term

c = F.col


def momentum(ret: Column, w: int) -> Column:
    """Compounded return of w rows, nulls left out; at least half of them must be known."""
    return ts.guarded(F.sum(F.ln(1 + F.when(ret > -1, ret))), ret, w, max(1, w // 2))


def compounded(ret: Column, w: int) -> Column:
    return F.exp(momentum(ret, w)) - 1


def price_volume() -> dict[str, Term]:
    """As terms, whose windows a code's rows give in one pass; `price_volume_columns` has the same as Columns."""
    x, w_of = e.column, e.windowed
    back = lambda w: w_of("compounded", compounded_least, x("ret"), w=w, least=max(1, w // 2))
    mean = lambda v, w, least: w_of("mean", ts.ts_mean, v, w=w, least=least)
    std = lambda v, w, least: w_of("std", ts.ts_std, v, w=w, least=least)
    null = e.row("null", lambda: F.lit(None).cast("double"))
    swing = e.where(x("limit_up_open") + x("limit_down_open") > 0, null, (x("high") - x("low")) / x("close"))
    out = {f"momentum_{w}": back(w) for w in (3, 10, 20, 60, 120)} | {f"reversal_{w}": -back(w) for w in (3, 5, 10, 20)}
    return out | {
        "momentum_skip": (1 + back(240)) / (1 + back(20)) - 1,
        "volatility_20": -std(x("ret"), 20, 10), "volatility_60": -std(x("ret"), 60, 30), "turnover_20": -mean(x("volume"), 20, 20),
        "illiquidity_20": mean(e.absolute(x("ret")) / x("amount"), 20, 10), "amplitude_20": -mean(swing, 20, 10), "to_high_52": x("close") / w_of("max", ts.ts_max, x("close"), w=52, least=52),
    }


def compounded_least(ret: Column, w: int, least: int) -> Column:
    return F.exp(ts.guarded(F.sum(F.ln(1 + F.when(ret > -1, ret))), ret, w, least)) - 1


def price_volume_columns() -> dict[str, Column]:
    one_word = c("limit_up_open") | c("limit_down_open")
    swing = F.when(~one_word, (c("high") - c("low")) / F.when(c("close") != 0, c("close")))
    cost = F.abs("ret") / F.when(c("amount") != 0, c("amount"))
    out = {f"momentum_{w}": compounded(c("ret"), w) for w in (3, 10, 20, 60, 120)} | {f"reversal_{w}": -compounded(c("ret"), w) for w in (3, 5, 10, 20)}
    return out | {
        "momentum_skip": (1 + compounded(c("ret"), 240)) / (1 + compounded(c("ret"), 20)) - 1,
        "volatility_20": -ts.ts_std(c("ret"), 20, 10), "volatility_60": -ts.ts_std(c("ret"), 60, 30), "turnover_20": -ts.ts_mean(c("volume"), 20, 20),
        "illiquidity_20": ts.ts_mean(cost, 20, 10), "amplitude_20": -ts.ts_mean(swing, 20, 10), "to_high_52": c("close") / ts.ts_max(c("close"), 52, 52),
    }


def technical() -> dict[str, Term]:
    """As terms; `technical_columns` has the same as Columns."""
    x = e.column
    mean = lambda v, w, least: e.windowed("mean", ts.ts_mean, v, w=w, least=least)
    sums = lambda v: e.windowed("sum", ts.ts_sum, v, w=26, least=13)
    null = e.row("null", lambda: F.lit(None).cast("double"))
    some = lambda v: e.where(v.same(0), null, v)
    means = {w: mean(x("close"), w, w // 2) for w in (5, 20)}
    return {f"bias_{w}": (x("close") - m) / m for w, m in means.items()} | {
        "psy_12": 100 * mean(e.number(x("ret") > 0), 12, 6),
        "ar_26": 100 * sums(x("high") - x("open")) / sums(some(x("open") - x("low"))),
        "br_26": 100 * sums(e.emax(x("high") - x("close_before"), 0)) / sums(some(e.emax(x("close_before") - x("low"), 0))),
        "turnover_acceleration": mean(x("volume"), 5, 2) / mean(x("volume"), 20, 10),
    }


def technical_columns() -> dict[str, Column]:
    positive = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    sums = lambda x: ts.ts_sum(x, 26, 13)
    before = c("close_before")
    below = F.nullif(positive(before - c("low")), F.lit(0.0))
    ratio = lambda a, b: ts.real(100 * a / F.when(b != 0, b))
    means = {w: ts.ts_mean(c("close"), w, w // 2) for w in (5, 20)}
    return {f"bias_{w}": (c("close") - m) / F.when(m != 0, m) for w, m in means.items()} | {
        "psy_12": 100 * ts.ts_mean(F.coalesce(c("ret") > 0, F.lit(False)).cast("double"), 12, 6),
        "ar_26": ratio(sums(c("high") - c("open")), sums(F.nullif(c("open") - c("low"), F.lit(0.0)))),
        "br_26": ratio(sums(positive(c("high") - before)), sums(below)),
        "turnover_acceleration": ts.ratio(ts.ts_mean(c("volume"), 5, 2), ts.ts_mean(c("volume"), 20, 10)),
    }


def limits() -> dict[str, Column]:
    number = lambda x: x.cast("double")
    up, down = number(c("limit_up") & ~c("limit_up_open")), number(c("limit_down"))
    count = lambda x: ts.ts_sum(x, 20, 1)
    return {
        "limit_state": F.when(c("limit_up"), 3.0).when(c("limit_down"), 1.0).otherwise(2.0),
        "limit_up_20": count(up), "limit_down_20": -count(down), "limit_net_20": count(number(c("limit_up"))) - count(down),
        "after_break_5": F.when(ts.delay(c("broke_limit"), 5), -(c("close") / ts.delay(c("close"), 5) - 1)),
    }


def sizes() -> dict[str, Column]:
    return {"log_size": -ts.log(c("cap")), "size_share": 1 - cs.cs_rank(c("cap")), "root_weight": F.sqrt(F.when(c("cap") > 0, c("cap")))}


def with_industry_means(panel: DataFrame, least: int = 2) -> DataFrame:
    """momentum and volume of 20 rows less their industry's mean, and the industry's momentum without the code itself."""
    made = panel.withColumns({"_m": compounded(c("ret"), 20), "_v": ts.ts_mean(c("volume"), 20, 10)})
    return made.withColumns({"relative_strength": cs.demean(c("_m"), "industry"), "neutral_turnover": cs.demean(c("_v"), "industry"), "industry_momentum": cs.exclude_self_mean(c("_m"), "industry", least)}).drop("_m", "_v")


def style_spread(panel: DataFrame, ret: str, cap: str, share: float = 0.3) -> DataFrame:
    """Per date the mean return of the smallest share of codes less that of the largest."""
    ranked = panel.withColumn("_r", cs.cs_rank(c(cap)))
    return ranked.groupBy("date").agg((F.avg(F.when(c("_r") <= share, c(ret))) - F.avg(F.when(c("_r") > 1 - share, c(ret)))).alias("spread"))


def normalized(panel: DataFrame, factors: list[str], share: float = 0.01, clip: float = 3.0) -> DataFrame:
    bounded = panel.withColumns({f"_{f}": cs.winsorize(c(f), share) for f in factors})
    return bounded.withColumns({f: cs.cs_zscore(c(f"_{f}"), clip) for f in factors}).drop(*[f"_{f}" for f in factors])
