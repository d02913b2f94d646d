"""Figures from cumulative reports as they were known at each time: trailing four quarters, single quarters and growth, with restatements.

A report is (code, report_date, available, values): values run from the start of the year to the report date, and a later row for the same report date replaces the earlier one
from its own date of availability on. A figure of a period needs reports of other periods too, so each report is handed to the periods that need it, in a
named role; within (code, period) the latest value of each role is carried from one date of availability to the next. No report meets all others of its code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the report of a period in the figures of another (or its own).
ROLES = ("now", "before", "year_ago", "last_annual")


def _readers() -> dict[str, Column]:
    q = F.col("_q")
    none = F.array().cast("array<int>")
    return {
        "now": F.array(q),
        "before": F.when(q % 4 != 3, F.array(q + 1)).otherwise(none),  # the next quarter of the same year
        "year_ago": F.array(q + 4),
        "last_annual": F.when(q % 4 == 3, F.array(q + 1, q + 2, q + 3, q + 4)).otherwise(none),
    }


def known_values(reports: DataFrame, values: list[str]) -> DataFrame:
    """code, quarter, available and for each value a column <value>_<role>: what was known of each role on each date on which something of it became known.

    Of several reports of one period that become available on one date the largest values count; reports without a code, report date, availability or any value are left out.
    """
    slim = reports.where("code is not null and report_date is not null and available is not null").groupBy("code", "report_date", "available").agg(*(F.max(v).alias(v) for v in values)).where(F.coalesce(*values).isNotNull())
    slim = slim.withColumn("_q", (F.year("report_date") * 4 + F.quarter("report_date") - 1).cast("int"))
    given = None
    for role, readers in _readers().items():
        part = slim.select("code", "available", F.explode(readers).alias("quarter"), *(F.col(v).alias(f"{v}_{role}") for v in values))
        given = part if given is None else given.unionByName(part, allowMissingColumns=True)
    names = [f"{v}_{role}" for role in ROLES for v in values]
    at_once = given.groupBy("code", "quarter", "available").agg(*(F.max(n).alias(n) for n in names))
    over = Window.partitionBy("code", "quarter").orderBy("available").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at_once.withColumns({n: F.last(n, ignorenulls=True).over(over) for n in names})


def newest_quarter(known: DataFrame, value: str) -> DataFrame:
    """The rows at which the code's newest reported quarter, or what is known of it, changed: a restatement of an older quarter that changes nothing of the newest one is left out."""
    reported = known.where(F.col(f"{value}_now").isNotNull())
    over = Window.partitionBy("code").orderBy("available", "quarter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of several quarters that become known on one date the last one stands.
    last = Window.partitionBy("code", "available")
    return reported.withColumn("_newest", F.max("quarter").over(over)).where(F.col("quarter") == F.col("_newest")).withColumn("_last", F.max("quarter").over(last)).where(F.col("quarter") == F.col("_last")).drop("_newest", "_last")


def trailing_year(value: str) -> Column:
    """The last four quarters: the year so far, the whole of last year, less last year's same months. An annual report is its own."""
    annual = F.col("quarter") % 4 == 3
    return F.when(annual, F.col(f"{value}_now")).otherwise(F.col(f"{value}_now") + F.col(f"{value}_last_annual") - F.col(f"{value}_year_ago"))


def single_quarter(value: str) -> Column:
    """The quarter alone: the year so far less the report before; a first quarter is its own."""
    return F.when(F.col("quarter") % 4 == 0, F.col(f"{value}_now")).otherwise(F.col(f"{value}_now") - F.col(f"{value}_before"))


def growth(value: str) -> Column:
    """Against the same months of last year, over their size."""
    base = F.abs(F.col(f"{value}_year_ago"))
    return (F.col(f"{value}_now") - F.col(f"{value}_year_ago")) / F.when(base > 1e-12, base)


def figures(reports: DataFrame, values: list[str]) -> DataFrame:
    """code, quarter, available and <value>_ttm, <value>_quarter, <value>_growth of the newest quarter reported by then, by the first of the values."""
    newest = newest_quarter(known_values(reports, values), values[0])
    made = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("ttm", trailing_year), ("quarter", single_quarter), ("growth", growth))]
    return newest.select("code", "quarter", "available", *made)
