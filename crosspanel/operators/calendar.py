"""Rebalance dates and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(date: Column, first: Column, freq: str) -> Column:
    """The period of a date. W-FRI: its Friday; ME: its month; 2W-FRI and 3D count from the first date."""
    friday = F.next_day(F.date_sub(date, 1), "Fri")
    if freq == "W-FRI":
        return friday
    if freq == "ME":
        return F.last_day(date)
    if freq == "2W-FRI":
        start = F.next_day(F.date_sub(first, 1), "Fri")
        return F.date_add(start, (F.ceil(F.datediff(friday, start) / 14) * 14).cast("int"))
    if freq == "3D":
        return F.date_add(first, (F.floor(F.datediff(date, first) / 3) * 3).cast("int"))
    raise ValueError(freq)


def rebalance_dates(dates: DataFrame, freq: str) -> DataFrame:
    """The last date of dates(date) in each period."""
    first = dates.agg(F.min("date")).first()[0]
    return dates.groupBy(bucket(F.col("date"), F.lit(first).cast("date"), freq).alias("bucket")).agg(F.max("date").alias("date")).select("date")


def resample_last(panel: DataFrame, columns: list[str], freq: str) -> DataFrame:
    """Each code's last known values in each period."""
    first = panel.agg(F.min("date")).first()[0]
    period = bucket(F.col("date"), F.lit(first).cast("date"), freq)
    return panel.groupBy("code", period.alias("period")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns])


def horizon_frequency(horizon: int) -> str:
    return "3D" if horizon <= 3 else "W-FRI" if horizon <= 7 else "2W-FRI" if horizon <= 15 else "ME"
