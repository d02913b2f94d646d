"""How much to hold: the market's trend, calm and breadth, each known the day before, as a share of exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeseries as ts



def _over() -> Window:
    return Window.orderBy("date")  # one row for each date


def _frame(w: int):
    return _over().rowsBetween(-(w - 1), Window.currentRow)


def _guarded(result: Column, x: Column, w: int, least: int) -> Column:
    return F.when(F.count(x).over(_frame(w)) >= least, ts.real(result.over(_frame(w))))


def breadth(panel: DataFrame, window: int = 20) -> DataFrame:
    """date and the share of the codes with a price whose price is above its own trailing mean."""
    mean = ts.ts_mean(F.col("close"), window, max(5, window // 2))
    above = F.coalesce(F.col("close") > F.col("_m"), F.lit(False))
    rows = panel.select("code", "date", "close").withColumn("_m", mean)
    return rows.groupBy("date").agg((F.count_if(above) / F.when(F.count("close") > 0, F.count("close"))).alias("breadth"))


def size_spread(panel: DataFrame, window: int = 20, share: float = 0.3, least: int = 20) -> DataFrame:
    """date and the mean return over `window` rows of the smallest codes less that of the largest, by the date's capitalisation; null with fewer than `least` sizes.

    panel: code, date, ret, cap. Dates without a return don't count, a loss of all is held at 99.9999 %.
    """
    log = F.when(F.col("ret").isNotNull(), F.log1p(F.greatest(F.col("ret"), F.lit(-0.999999))))
    rows = panel.select("code", "date", "cap", log.alias("_l")).withColumn("_w", F.expm1(ts.ts_sum(F.col("_l"), window, max(5, window // 2))))
    day = Window.partitionBy("date")
    bounds = {"_lo": F.percentile("cap", F.lit(share)).over(day), "_hi": F.percentile("cap", F.lit(1 - share)).over(day), "_n": F.count("cap").over(day)}
    means = rows.withColumns(bounds).groupBy("date").agg(F.max("_n").alias("_n"), F.avg(F.when(F.col("cap") <= F.col("_lo"), F.col("_w"))).alias("_s"), F.avg(F.when(F.col("cap") >= F.col("_hi"), F.col("_w"))).alias("_g"))
    return means.select("date", F.when(F.col("_n") >= least, F.col("_s") - F.col("_g")).alias("size_style"))


def position_regime(index: DataFrame, panel: DataFrame | None = None, sizes: DataFrame | None = None, least_exposure: float = 0.3, trend: int = 60, vol: int = 20, lookback: int = 252, breadth_window: int = 20, forced: float | None = None) -> DataFrame:
    """date, mkt_trend, mkt_vol, mkt_breadth, size_style, trend_on, vol_ok, breadth_on, score, target_exposure of index(date, px).

    All signals are those of the date before. Trend: price against its mean. Vol: deviation of returns against its rolling median. Breadth doesn't count where it isn't
    known. The score is the number of signals that are on, the exposure runs from least_exposure to 1 with its share of those that count; `forced` replaces it.
    """
    for x in (least_exposure, forced):
        if x is not None and not 0 <= x <= 1:
            raise ValueError(f"{x} is no share")
    px = F.col("px")
    before = F.lag(px, 1).over(_over())
    rows = index.select("date", F.col("px").cast("double").alias("px")).withColumn("_r", ts.real(px / F.when(before != 0, before)) - 1)
    mean = _guarded(F.avg(px), px, trend, max(20, trend // 2))
    rows = rows.withColumns({"_trend": ts.real(px / F.when(mean != 0, mean)) - 1, "_vol": _guarded(F.stddev_samp("_r"), F.col("_r"), vol, max(5, vol // 2))})
    middle = F.when(F.count("_vol").over(_frame(lookback)) >= 60, F.percentile("_vol", F.lit(0.5)).over(_frame(lookback)))
    rows = rows.withColumn("_calm", F.col("_vol") / F.when(middle != 0, middle))
    rows = rows.join(breadth(panel, breadth_window), "date", "left") if panel is not None else rows.withColumn("breadth", F.lit(None).cast("double"))
    rows = rows.join(sizes, "date", "left") if sizes is not None else rows.withColumn("size_style", F.lit(None).cast("double"))
    late = lambda c: F.lag(c, 1).over(_over())
    rows = rows.select("date", late("_trend").alias("mkt_trend"), late("_calm").alias("mkt_vol"), late("breadth").alias("mkt_breadth"), late("size_style").alias("size_style"))
    on = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    rows = rows.withColumns({"trend_on": on(F.col("mkt_trend") > 0), "vol_ok": on(F.col("mkt_vol") < 1), "breadth_on": (F.col("mkt_breadth") > 0.5).cast("double")})
    score = F.col("trend_on") + F.col("vol_ok") + F.coalesce("breadth_on", F.lit(0.0))
    parts = F.when(F.col("breadth_on").isNull(), 2.0).otherwise(3.0)
    target = F.lit(float(forced)) if forced is not None else F.greatest(F.least(least_exposure + (1 - least_exposure) * score / parts, F.lit(1.0)), F.lit(least_exposure))
    return rows.withColumns({"score": score, "target_exposure": target})


def exposures(regime: DataFrame, signals: DataFrame, default: float = 1.0) -> DataFrame:
    """date and exposure of each of signals(date): that of the date itself, or of the last date before it if the regime hasn't the date; the default without any.

    An exposure that isn't known on the date itself is the default, not an older one.
    """
    known = regime.select("date", F.struct(F.col("target_exposure").alias("e")).alias("_s"), (F.col("target_exposure").isNotNull()).alias("_has"))
    marked = signals.select("date").distinct().join(known, "date", "full").withColumn("_in", F.col("_s").isNotNull())
    older = F.last(F.when(F.col("_has"), F.col("_s")), ignorenulls=True).over(_over().rowsBetween(Window.unboundedPreceding, -1))
    found = marked.withColumn("_e", F.when(F.col("_in"), F.col("_s.e")).otherwise(older["e"]))
    return signals.select("date").join(found.select("date", F.greatest(F.least(F.coalesce("_e", F.lit(default)), F.lit(1.0)), F.lit(0.0)).alias("exposure")), "date")
