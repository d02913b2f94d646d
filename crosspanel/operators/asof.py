"""Point-in-time joins: as of a date, dated segments, intervals, events onto the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def as_of(panel: DataFrame, reports: DataFrame, columns: list[str], available: str = "available") -> DataFrame:
    """For each row of the panel the last known value of each column up to its date.

    Both sides are put together and carried forward within a code; a report is in force on its
    own date. Several reports of one code and date count as their mean.
    """
    merged = reports.groupBy("code", F.col(available).alias("date")).agg(*[F.avg(c).alias(c) for c in columns])
    both = panel.select("code", "date", F.lit(1).alias("grid"), *[F.lit(None).cast("double").alias(c) for c in columns]).union(merged.select("code", "date", F.lit(0).alias("grid"), *[F.col(c).cast("double") for c in columns]))
    over = Window.partitionBy("code").orderBy("date", "grid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumns({c: F.last(c, ignorenulls=True).over(over) for c in columns})
    return carried.where("grid = 1").drop("grid")


def with_available_dates(reports: DataFrame, report: str = "report_date", announced: str = "ann_date", enough: float = 0.8) -> DataFrame:
    """Announcement dates where at least `enough` of the rows have one (else, and for the others, the statutory date)."""
    statutory = scalars.available_date(F.col(report))
    if announced not in reports.columns:
        return reports.withColumn("available", statutory)
    known = reports.agg(F.avg(F.col(announced).isNotNull().cast("double"))).first()[0] or 0.0
    return reports.withColumn("available", F.coalesce(F.col(announced), statutory) if known >= enough else statutory)


def segments(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Dated segments from changes(code, effective_date, ...): each ends the day before the next begins."""
    following = F.lead("effective_date").over(Window.partitionBy("code").orderBy("effective_date"))
    return changes.select("code", "effective_date", F.date_sub(following, 1).alias("end_date"), *columns)


def segment_as_of(panel: DataFrame, dated: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the segment in force on each row's date, the latest if several are.

    Segments of a code are few, so the equi-join on code with a date range stays near the panel's size.
    """
    hit = panel.select("code", "date").join(dated, "code").where("effective_date <= date and (end_date is null or date <= end_date)")
    latest = hit.groupBy("code", "date").agg(*[F.max_by(c, "effective_date").alias(c) for c in columns])
    return panel.join(latest, ["code", "date"], "left")


def interval_flag(panel: DataFrame, intervals: DataFrame, name: str) -> DataFrame:
    """Whether a row's date lies in one of the code's intervals(code, start_date, end_date or null).

    A date lies in one if the latest end of those begun by then isn't before it, so both sides are put
    together and that end is carried forward within a code; no row meets each interval of its code.
    """
    ends = F.max(F.coalesce("end_date", F.lit("9999-12-31").cast("date"))).alias("_end")
    begun = intervals.where("code is not null and start_date is not null").groupBy("code", F.col("start_date").alias("date")).agg(ends)
    both = panel.withColumn("_grid", F.lit(True)).unionByName(begun.withColumn("_grid", F.lit(False)), allowMissingColumns=True)
    over = Window.partitionBy("code").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.coalesce(F.max("_end").over(over) >= F.col("date"), F.lit(False))).where("_grid").drop("_grid", "_end")


def events_on_grid(panel: DataFrame, events: DataFrame, how, name: str, roll: bool = False) -> DataFrame:
    """Events(code, date, ...) aggregated by `how` and joined to the grid; with roll, an event between
    two grid dates counts on the later one, else it is dropped."""
    if roll:
        dates = panel.select("date").distinct().withColumn("previous", F.lag("date").over(Window.orderBy("date")))  # one row for each date
        days = events.select(F.col("date").alias("event_date")).distinct()  # met with the grid once, not by each event
        later = days.join(F.broadcast(dates), (F.col("event_date") <= F.col("date")) & (F.col("previous").isNull() | (F.col("event_date") > F.col("previous")))).drop("previous")
        events = events.withColumnRenamed("date", "event_date").join(F.broadcast(later), "event_date").drop("event_date")
    return panel.join(events.groupBy("code", "date").agg(how.alias(name)), ["code", "date"], "left")
