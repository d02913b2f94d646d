"""Hold periods of a portfolio: executions, daily returns, exits of what couldn't be sold, values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeseries as ts


def hold_periods(dates: DataFrame, signals: DataFrame) -> DataFrame:
    """(date, period, executed): of each date the latest signal date before it, and the first date after that signal, where orders are filled.

    dates(date): the calendar; signals(date): dates on which holdings are chosen. One row for each date, so one
    ordered pass over the calendar is enough.
    """
    marked = dates.join(signals.select("date", F.col("date").alias("signal")), "date", "left")
    before = F.last("signal", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    known = marked.select("date", before.alias("period")).where("period is not null")
    return known.withColumn("executed", F.min("date").over(Window.partitionBy("period")))


def daily_returns(panel: DataFrame, holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """ret and nav of every held code on every date of its period.

    panel(code, date, open, close, volume, no_sale): no_sale marks dates on which the code can't be sold. holdings(period, code, stuck): stuck
    codes couldn't be sold at execution; they leave at the close of the first later date on which they can be. On the day of execution a code
    earns from its open to the close, or nothing if it has none (in a panel without a column open, from the close before it to the close); then from close to close; after a suspension from the last close inside the period. Suspended
    days earn nothing.
    """
    panel = panel.withColumn("close_before", F.lag("close").over(ts.whole()))
    rows = panel.join(F.broadcast(periods), "date").join(holdings, ["period", "code"])  # one row for each date
    path = Window.partitionBy("period", "code").orderBy("date")
    suspended = ~F.coalesce((F.col("close") > 0) & (F.col("volume") > 0), F.lit(False))
    rows = rows.withColumns({"suspended": suspended, "first_day": F.col("date") == F.col("executed"), "last_close": F.last("close", ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, -1))})
    sellable = F.col("stuck") & ~F.col("first_day") & ~F.col("suspended") & ~F.coalesce("no_sale", F.lit(False))
    rows = rows.withColumn("exit_date", F.min(F.when(sellable, F.col("date"))).over(Window.partitionBy("period", "code")))
    base = F.when(F.col("first_day"), F.col("open" if "open" in panel.columns else "close_before")).otherwise(F.col("last_close"))
    earned = F.when((base > 0) & F.col("close").isNotNull() & ~F.col("suspended"), F.col("close") / F.when(base > 0, base) - 1)
    after_exit = F.coalesce(F.col("date") > F.col("exit_date"), F.lit(False))
    rows = rows.withColumn("ret", F.when(after_exit, 0.0).otherwise(F.coalesce(earned, F.lit(0.0))))
    value = F.exp(F.sum(F.ln(1 + F.col("ret"))).over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select("period", "code", "date", "executed", "exit_date", "suspended", "ret", value.alias("nav"))


def portfolio_values(paths: DataFrame, weights: DataFrame | None = None, cost: float = 0.0) -> DataFrame:
    """(period, date, nav): bought once and held; equal weights unless weights(period, code, weight) are given, of which the sum doesn't
    matter (all equal where it isn't positive). The cost is paid at the start."""
    weighted = paths.withColumn("weight", F.lit(1.0)) if weights is None else paths.join(weights, ["period", "code"], "left")
    w = F.coalesce("weight", F.lit(0.0))
    sums = weighted.groupBy("period", "date").agg(F.sum(w).alias("w"), F.sum(w * F.col("nav")).alias("wn"), F.avg("nav").alias("equal"), F.count("*").alias("held"))
    return sums.select("period", "date", (F.when(F.col("w") > 0, F.col("wn") / F.when(F.col("w") > 0, F.col("w"))).otherwise(F.col("equal")) * (1 - cost)).alias("nav"), "held")


def period_results(values: DataFrame, paths: DataFrame) -> DataFrame:
    """Return of each period and how many stuck codes left within it."""
    last = values.groupBy("period").agg((F.max_by("nav", "date") - 1).alias("ret"), F.max("held").alias("held"))
    left = paths.groupBy("period").agg(F.count_distinct(F.when(F.col("exit_date").isNotNull(), F.col("code"))).alias("left_early"))
    return last.join(left, "period")


def exposed(ret, exposure):
    """A return under a share of exposure, held between 0 and 1."""
    return ret * F.greatest(F.least(exposure, F.lit(1.0)), F.lit(0.0))


def index_returns(index: DataFrame, periods: DataFrame) -> DataFrame:
    """period and ret of an index(date, px) over the dates of each of periods(date, period, executed), from the day of execution on.

    That day earns from the last known price before it, later days only where the day before has a price too; null for periods without any price.
    """
    before = F.last("px", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))  # one row for each date
    known = index.groupBy("date").agg(F.max("px").alias("px")).withColumns({"_before": before, "_day_before": F.lag("px").over(Window.orderBy("date"))})
    rows = periods.join(F.broadcast(known), "date", "left").where(F.col("date") >= F.col("executed"))
    base = F.when(F.col("date") == F.col("executed"), F.col("_before")).otherwise(F.col("_day_before"))
    step = F.when((base > 0) & F.col("px").isNotNull(), F.col("px") / F.when(base > 0, base)).otherwise(1.0)
    chained = rows.withColumn("_step", step).groupBy("period").agg(F.product("_step").alias("_nav"), F.count("px").alias("_n"))
    return chained.select("period", F.when(F.col("_n") > 0, F.col("_nav") - 1).alias("ret"))
