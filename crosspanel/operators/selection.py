"""Choosing factors: rolling statistics, gates, redundancy and pool schedules. One row for each factor (and date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_stats(ics: DataFrame, window: int = 52) -> DataFrame:
    """For each factor and date the mean and ICIR of the `window` earlier dates, the date itself not counted."""
    past = Window.partitionBy("factor").orderBy("date").rowsBetween(-window, -1)
    stats = ics.select("factor", "date", F.count("ic").over(past).alias("n"), F.avg("ic").over(past).alias("mean"), F.stddev_pop("ic").over(past).alias("std"))
    return stats.withColumn("icir", F.col("mean") / F.when(F.col("std") > 1e-12, F.col("std"))).drop("std")


def passes_gate(mean: Column, icir: Column, n: Column, least_mean: float = 0.015, least_icir: float = 0.3, periods: int = 52) -> Column:
    return F.coalesce((n >= periods) & (F.abs(mean) >= least_mean) & (F.abs(icir) >= least_icir), F.lit(False))


def recent_retention(ics: DataFrame, recent: int) -> DataFrame:
    """|ICIR| of the last `recent` dates over |ICIR| of the earlier ones, by factor."""
    place = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("date")))
    marked = ics.where("ic is not null").withColumn("late", place <= recent)
    part = lambda late: (F.avg(F.when(F.col("late") == late, F.col("ic"))), F.stddev_pop(F.when(F.col("late") == late, F.col("ic"))))
    (m1, s1), (m0, s0) = part(True), part(False)
    sums = marked.groupBy("factor").agg(m1.alias("m1"), s1.alias("s1"), m0.alias("m0"), s0.alias("s0"))
    ratio = lambda m, s: F.abs(F.col(m) / F.when(F.col(s) > 1e-12, F.col(s)))
    out = sums.select("factor", ratio("m1", "s1").alias("recent_icir"), ratio("m0", "s0").alias("past_icir"))
    return out.withColumn("retention", F.col("recent_icir") / F.when(F.col("past_icir") > 1e-12, F.col("past_icir")))


def early_late_ratio(ics: DataFrame) -> DataFrame:
    """|mean| of the later half of each factor's series over |mean| of the earlier half; null for fewer than eight values."""
    by = Window.partitionBy("factor")
    known = ics.where("ic is not null").withColumns({"place": F.row_number().over(by.orderBy("date")), "n": F.count("*").over(by)})
    early = F.col("place") <= F.floor(F.col("n") / 2)
    sums = known.groupBy("factor").agg(F.count("*").alias("n"), F.avg(F.when(early, F.col("ic"))).alias("early"), F.avg(F.when(~early, F.col("ic"))).alias("late"))
    return sums.withColumn("ratio", F.when(F.col("n") >= 8, F.abs("late") / F.when(F.abs("early") >= 1e-12, F.abs("early"))))


def ic_correlations(ics: DataFrame, least: int = 10) -> DataFrame:
    """Correlation of the IC series of every two factors over their common dates.

    The pairs are of factors, whose number is that of the registry; the join is on the date.
    """
    known = ics.where("ic is not null").select("date", "factor", "ic")
    other = known.select("date", F.col("factor").alias("other"), F.col("ic").alias("other_ic"))
    sums = known.join(other, "date").where("factor < other").groupBy("factor", "other").agg(
        F.count("*").alias("n"), F.covar_pop("ic", "other_ic").alias("c"), (F.stddev_pop("ic") * F.stddev_pop("other_ic")).alias("s")
    )
    return sums.where(F.col("n") >= least).select("factor", "other", "n", F.when(F.col("s") > 1e-12, F.col("c") / F.when(F.col("s") > 1e-12, F.col("s"))).alias("corr"))


def without_redundant(stats: DataFrame, correlations: DataFrame, limit: float = 0.7) -> DataFrame:
    """Greedy choice: by falling |ICIR| (ties by name), a factor stays unless |corr| with one kept is above the limit.

    The choice is sequential; both tables are of the registry's size, so one task walks over them.
    """
    ranked = stats.select("factor", F.abs("icir").alias("strength")).where("strength is not null")
    links = correlations.where(F.abs("corr") > limit)
    near = links.select("factor", F.col("other").alias("near")).union(links.select("other", F.col("factor").alias("near"))).groupBy("factor").agg(F.collect_list("near").alias("near"))
    rows = ranked.join(near, "factor", "left").agg(F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("place"), "factor", F.coalesce("near", F.array().cast("array<string>")).alias("near")))).alias("rows"))
    kept = F.aggregate("rows", F.array().cast("array<string>"), lambda kept, r: F.when(F.arrays_overlap(kept, r["near"]), kept).otherwise(F.array_append(kept, r["factor"])))
    return rows.select(F.posexplode(kept).alias("place", "factor")).select("factor", (F.col("place") + 1).alias("place"))


def active_pool(schedule: DataFrame, dates: DataFrame) -> DataFrame:
    """The factors of the latest decision on or before each date; dates before the first have none.

    schedule: date, factor. dates: date.
    """
    decisions = schedule.select("date").distinct().select("date", F.col("date").alias("decision"))
    both = dates.select("date").distinct().withColumn("decision", F.lit(None).cast("date")).union(decisions)
    # One row for each date of the calendar: small enough for one task's ordered pass.
    last = F.max("decision").over(Window.partitionBy(F.lit(0)).orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    held = both.select("date", "decision", last.alias("at")).where("decision is null and at is not null").select("date", "at")
    return held.join(schedule.select(F.col("date").alias("at"), "factor"), "at").select("date", "factor")
