"""Cleaning of price panels and the flags that say when a code can be traded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeseries as ts


def deduplicated(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")


def spike(price: Column) -> Column:
    """More than three times, or less than a third of, the mean of the row before and the one after."""
    around = (ts.delay(price, 1) + F.lead(price, 1).over(ts.whole())) / 2
    return F.coalesce((price / around > 3) | (price / around < F.lit(1) / 3), F.lit(False))


def last_known(price: Column) -> Column:
    return F.last(price, ignorenulls=True).over(ts.whole().rowsBetween(Window.unboundedPreceding, -1))


def clean_prices(panel: DataFrame, columns: list[str], spikes: bool = True) -> DataFrame:
    """Non-positive prices, jumps of over 100 % from the last known price, first prices and spikes become null."""
    positive = panel.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in columns})
    steady = positive.withColumns({c: F.when(F.abs(F.col(c) / last_known(F.col(c)) - 1) <= 1, F.col(c)) for c in columns})
    return steady.withColumns({c: F.when(~spike(F.col(c)), F.col(c)) for c in columns}) if spikes else steady


def clean_bars(panel: DataFrame) -> DataFrame:
    """clean_prices on the close; where it is null the bar's other prices are too."""
    cleaned = clean_prices(panel, ["close"])
    return cleaned.withColumns({c: F.when(F.col("close").isNotNull() & (F.col(c) > 0), F.col(c)) for c in ("open", "high", "low")})


def limit_flags(panel: DataFrame, threshold: float = 0.095, wide: float = 0.195, slack: float = 0.98) -> DataFrame:
    """limit_up, limit_down, any_limit, limit_up_open, limit_down_open and broke_limit."""
    most = F.when(F.col("code").rlike("^(688|300|301)"), wide).otherwise(threshold) * slack
    change = F.col("close") / ts.delay(F.col("close"), 1) - 1
    false = F.lit(False)
    up = F.coalesce((F.col("close") == F.col("high")) & (change >= most), false)
    down = F.coalesce((F.col("close") == F.col("low")) & (change <= -most), false)
    flagged = panel.withColumns({"limit_up": up, "limit_down": down}).withColumns({
        "any_limit": F.col("limit_up") | F.col("limit_down"),
        "limit_up_open": F.col("limit_up") & F.coalesce(F.col("open") == F.col("close"), false),
        "limit_down_open": F.col("limit_down") & F.coalesce(F.col("open") == F.col("close"), false),
        "was_up": F.coalesce(F.lag("limit_up").over(ts.whole()), false),
    })
    return flagged.withColumn("broke_limit", F.col("was_up") & ~F.col("limit_up")).drop("was_up")


def clean_return(panel: DataFrame) -> DataFrame:
    """ret: change of the close, null on limit days."""
    return limit_flags(panel).withColumn("ret", F.when(~F.col("any_limit"), F.col("close") / ts.delay(F.col("close"), 1) - 1))


def clean_nonnegative(x: Column) -> Column:
    x = ts.real(x)
    return F.when(x >= 0, x)


def clean_positive(x: Column) -> Column:
    x = ts.real(x)
    return F.when(x > 0, x)


def unit_ratio(panel: DataFrame) -> DataFrame:
    """One row: the median over dates of each date's median of amount over volume times close."""
    share = F.col("amount") / F.when(F.col("volume") * F.col("close") > 0, F.col("volume") * F.col("close"))
    daily = panel.groupBy("date").agg(F.percentile(share, F.lit(0.5)).alias("m"))
    return daily.agg(F.percentile("m", F.lit(0.5)).alias("ratio")).withColumn("valid", F.col("ratio").between(0.5, 2.0))


def masked_after(panel: DataFrame, ends: DataFrame, columns: list[str]) -> DataFrame:
    """Columns become null after each code's end date in ends(code, delist_date)."""
    joined = panel.join(ends, "code", "left")
    alive = F.col("delist_date").isNull() | (F.col("date") <= F.col("delist_date"))
    return joined.withColumns({c: F.when(alive, F.col(c)) for c in columns}).drop("delist_date")


def sparse_tail_cut(panel: DataFrame, column: str, part: float = 0.5, back: int = 40, skip: int = 10) -> DataFrame:
    """Dates up to the last one covered by at least `part` of a typical date.

    Typical: the median count of the `back` dates that end `skip` dates before the last.
    """
    counts = panel.groupBy("date").agg(F.count(column).alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.orderBy(F.desc("date"))))  # one row for each date
    typical = ranked.where(F.col("k").between(skip + 1, skip + back)).agg(F.percentile("n", F.lit(0.5)).alias("m")).first()["m"]
    last = counts.where(F.col("n") >= part * (typical or 0)).agg(F.max("date")).first()[0]
    return panel.where(F.col("date") <= F.lit(last))


def tradable(panel: DataFrame, age_days: int = 60) -> DataFrame:
    """can_buy and can_sell: trading, aged, and not held at the limit of that side."""
    first = F.min(F.when(F.col("close").isNotNull(), F.col("date"))).over(Window.partitionBy("code"))
    trading = F.coalesce(F.col("volume") > 0, F.lit(False)) & F.col("close").isNotNull()
    aged = F.coalesce(F.datediff("date", first) >= age_days, F.lit(False))
    return panel.withColumns({"can_buy": trading & aged & ~F.col("limit_up"), "can_sell": trading & ~F.col("limit_down")})
