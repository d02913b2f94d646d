"""How an information coefficient behaves over time: recent, early, by part; gates and labels. One row for each factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ic as ics_of


def _known(ics: DataFrame) -> DataFrame:
    """The dates with a coefficient, numbered from both ends, with the bounded coefficient."""
    by = Window.partitionBy("factor")
    known = ics.where("ic is not null").select("factor", "date", "ic", ics_of.prepared(F.col("ic")).alias("x"))
    return known.withColumns({"from_end": F.row_number().over(by.orderBy(F.desc("date"))), "place": F.row_number().over(by.orderBy("date")), "n": F.count("*").over(by)})


def ratio(mean: Column, std: Column) -> Column:
    """Mean over deviation; 0 where there is no deviation."""
    return F.when(std > 1e-12, mean / F.when(std > 1e-12, std)).otherwise(F.when(mean.isNotNull(), 0.0))


def payoff_ratio(ics: DataFrame) -> DataFrame:
    """Mean of the positive coefficients over mean size of the negative ones."""
    up, down = F.avg(F.when(F.col("ic") > 1e-12, F.col("ic"))), F.avg(F.when(F.col("ic") < -1e-12, -F.col("ic")))
    return ics.groupBy("factor").agg((up / down).alias("payoff"))


def recent_stats(ics: DataFrame, lookback: int) -> DataFrame:
    """Mean, ICIR and share of positive coefficients of the last `lookback` ones; null for fewer than three."""
    last = _known(ics).where(F.col("from_end") <= lookback).groupBy("factor").agg(F.count("*").alias("n"), F.avg("ic").alias("m"), F.stddev_pop("ic").alias("s"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("p"))
    enough = F.col("n") >= 3
    return last.select("factor", "n", F.when(enough, F.col("m")).alias("recent_ic"), F.when(enough & (F.col("s") > 1e-12), F.col("m") / F.col("s")).alias("recent_icir"), F.when(enough, F.col("p")).alias("recent_positive"))


def retention(ics: DataFrame, recent: int) -> DataFrame:
    """Of the bounded series: mean and ICIR of the last `recent` dates, ICIR of the earlier ones and |first| over |second|.

    Null for series of fewer than recent + 3 dates.
    """
    late = F.col("from_end") <= recent
    part = lambda side, f: f(F.when(side, F.col("x")))
    sums = _known(ics).groupBy("factor").agg(F.count("*").alias("n"), part(late, F.avg).alias("ic_recent"), ratio(part(late, F.avg), part(late, F.stddev_pop)).alias("icir_recent"), ratio(part(~late, F.avg), part(~late, F.stddev_pop)).alias("icir_past"))
    enough = (F.col("n") >= recent + 3) & F.lit(recent >= 3)
    out = sums.select("factor", *[F.when(enough, F.col(c)).alias(c) for c in ("ic_recent", "icir_recent", "icir_past")])
    return out.withColumn("retention", F.abs("icir_recent") / F.when(F.abs("icir_past") > 1e-12, F.abs("icir_past")))


def segment_trend(ics: DataFrame, periods: int, segments: int = 3, eps: float = 0.02) -> DataFrame:
    """rising: |ICIR| of the last `segments` parts of `periods` dates grows from the first to the last, and never falls by more than eps."""
    tail = _known(ics).where((F.col("from_end") <= periods * segments) & (F.col("n") >= periods * segments))
    parts = tail.withColumn("segment", (segments - F.ceil(F.col("from_end") / periods)).cast("int")).groupBy("factor", "segment").agg(F.abs(ratio(F.avg("x"), F.stddev_pop("x"))).alias("v"))
    wide = parts.groupBy("factor").agg(*[F.max(F.when(F.col("segment") == k, F.col("v"))).alias(f"v{k}") for k in range(segments)])
    rising = F.col(f"v{segments - 1}") > F.col("v0")
    for k in range(segments - 1):
        rising = rising & (F.col(f"v{k + 1}") + eps >= F.col(f"v{k}"))
    return ics.select("factor").distinct().join(wide, "factor", "left").withColumn("rising", F.coalesce(rising, F.lit(False)))


def style_reversal(ics: DataFrame, recent: int, strong: float = 0.015, limit: float = 0.75) -> DataFrame:
    """fraction: share of the last `recent` coefficients that are strong and of the other sign than the mean of all; reversed: over the limit."""
    mean = F.avg("ic").over(Window.partitionBy("factor"))
    opposite = ((F.signum("ic") != F.signum("mean")) & (F.abs("ic") > strong)).cast("double")
    late = _known(ics).withColumn("mean", mean).where((F.col("from_end") <= recent) & (F.col("n") >= max(4, recent)) & (F.abs("mean") > 1e-15))
    out = ics.select("factor").distinct().join(late.groupBy("factor").agg(F.avg(opposite).alias("fraction")), "factor", "left")
    return out.withColumn("reversed", F.coalesce(F.col("fraction") > limit, F.lit(False)))


def stability(ics: DataFrame, window: int = 12) -> DataFrame:
    """Means over the rolling windows of deviation and ICIR, the least rolling mean, and the share of years with the sign of all."""
    past = Window.partitionBy("factor").orderBy("date").rowsBetween(1 - window, Window.currentRow)
    known = ics.where("ic is not null").select("factor", "date", "ic", F.count("ic").over(past).alias("k"), F.avg("ic").over(past).alias("m"), F.stddev_pop("ic").over(past).alias("s"))
    enough = F.col("k") >= max(3, window // 2)
    rolled = known.groupBy("factor").agg(F.avg(F.when(enough, F.col("s"))).alias("rolling_std"), F.avg(F.when(enough & (F.col("s") > 1e-12), F.col("m") / F.col("s"))).alias("rolling_icir"), F.min(F.when(enough, F.col("m"))).alias("worst_mean"), F.avg("ic").alias("mean"))
    years = known.groupBy("factor", F.year("date").alias("year")).agg(F.avg("ic").alias("y"))
    same = years.join(rolled.select("factor", "mean"), "factor").groupBy("factor").agg(F.avg(F.when(F.abs("mean") > 1e-15, (F.signum("y") == F.signum("mean")).cast("double"))).alias("same_sign_years"))
    return rolled.join(same, "factor").drop("mean")


def half_life(decay: DataFrame, horizon: str = "horizon", value: str = "abs_ic") -> DataFrame:
    """The horizon at which |IC| has fallen to half of its peak, between two horizons on a straight line; the longest one where it hasn't.

    decay: factor, horizon, value. Null for fewer than two values or a peak of zero.
    """
    by = Window.partitionBy("factor")
    known = decay.where(F.col(value).isNotNull()).withColumns({"peak": F.max(value).over(by), "n": F.count("*").over(by), "longest": F.max(horizon).over(by)})
    at_peak = F.min(F.when(F.col(value) == F.col("peak"), F.col(horizon))).over(by)
    steps = known.withColumns({"at_peak": at_peak, "v0": F.lag(value).over(by.orderBy(horizon)), "h0": F.lag(horizon).over(by.orderBy(horizon))})
    low = (F.col(horizon) > F.col("at_peak")) & (F.col(value) <= F.col("peak") / 2)
    crossing = F.when(F.col("v0") == F.col(value), F.col(horizon).cast("double")).otherwise(F.col("h0") + (F.col("peak") / 2 - F.col("v0")) / (F.col(value) - F.col("v0")) * (F.col(horizon) - F.col("h0")))
    found = steps.groupBy("factor").agg(F.max("n").alias("n"), F.max("peak").alias("peak"), F.max("longest").alias("longest"), F.min_by(F.when(low, crossing), F.when(low, F.col(horizon))).alias("crossing"))
    return found.select("factor", F.when((F.col("n") >= 2) & (F.col("peak") > 0), F.coalesce("crossing", F.col("longest").cast("double"))).alias("half_life"))


def newey_west_default(ics: DataFrame, most: int = 12) -> DataFrame:
    """t of the bounded series' mean with Bartlett weights over floor(4 (n / 100)^(2/9)) lags, one at least (at most `most`); null for fewer than three dates."""
    by = Window.partitionBy("factor")
    known = ics.where("ic is not null").select("factor", "date", ics_of.prepared(F.col("ic")).alias("x"))
    centred = known.withColumn("e", F.col("x") - F.avg("x").over(by))
    sums = centred.select("factor", "x", *[(F.col("e") * F.lag("e", k).over(by.orderBy("date")) if k else F.col("e") * F.col("e")).alias(f"g{k}") for k in range(most + 1)])
    sums = sums.groupBy("factor").agg(F.avg("x").alias("mean"), F.count("*").alias("n"), *[F.coalesce(F.sum(f"g{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(most + 1)])
    sums = sums.withColumn("lags", F.least(F.greatest(ics_of.default_lags(F.col("n")), F.lit(1)), F.lit(most)))
    total = F.col("g0")
    for k in range(1, most + 1):
        total = total + F.when(F.col("lags") >= k, 2 * (1 - k / (F.col("lags") + 1)) * F.col(f"g{k}")).otherwise(0.0)
    variance = total / (F.col("n") * F.col("n"))
    return sums.select("factor", "n", F.col("lags").cast("int").alias("lags"), F.when((F.col("n") >= 3) & (variance > 0), F.col("mean") / F.sqrt(F.when(variance > 0, variance))).alias("nw_t"))


def trigger_summary(panel: DataFrame, factor: str, label: str, direction: Column, least: int = 5) -> DataFrame:
    """hit share and mean edge, over dates, of codes whose factor has the direction's sign against all codes with a label.

    direction: a column of the panel's factor group; 0 counts as up. panel has the column `factor`.
    """
    sign = F.when(F.abs(direction) < 1e-12, 1.0).otherwise(F.signum(direction))
    known = panel.where(F.col(label).isNotNull())
    hit = F.coalesce(F.col(factor) * sign > 0, F.lit(False))
    daily = known.groupBy("factor", "date").agg(F.count("*").alias("n"), F.count_if(hit).alias("k"), (F.avg(F.when(hit, F.col(label))) - F.avg(label)).alias("edge")).where((F.col("n") >= least) & (F.col("k") >= least))
    return daily.groupBy("factor").agg(F.avg((F.col("edge") > 1e-15).cast("double")).alias("payoff_hit"), F.avg("edge").alias("payoff_edge"), F.count("*").alias("n_days"))


def quantile_spread(panel: DataFrame, x: str, y: str, n: int = 5, least: int = 30) -> DataFrame:
    """Per date the mean label of the highest and lowest of n buckets by rank, against the mean of all, and the long side's share of the spread."""
    known = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    by = Window.partitionBy("date")
    ranked = known.withColumns({"_n": F.count("*").over(by), "_r": F.row_number().over(by.orderBy(x, "code"))}).where(F.col("_n") >= least)
    bucket = F.floor((F.col("_r") - 1) * n / F.col("_n"))
    daily = ranked.groupBy("date").agg(F.avg(F.when(bucket == 0, F.col(y))).alias("low"), F.avg(F.when(bucket == n - 1, F.col(y))).alias("high"), F.avg(y).alias("all"), F.count("*").alias("n"))
    return daily.select("date", "n", "low", "high", (F.col("high") - F.col("all")).alias("long_excess"), (F.col("all") - F.col("low")).alias("short_contribution"), (F.col("high") - F.col("low")).alias("spread"))


def spread_summary(daily: DataFrame, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Means over dates; the long share is taken from the means, and tells where the spread comes from."""
    means = daily.agg(*[F.avg(c).alias(c) for c in ("low", "high", "long_excess", "short_contribution", "spread")], F.count("*").alias("n_days"))
    return means.withColumn("long_share", long_share(F.col("long_excess"), F.col("short_contribution"))).withColumn("source", spread_source(F.col("long_excess"), F.col("short_contribution"), low, high))


def long_share(long_excess: Column, short_contribution: Column) -> Column:
    both = long_excess + short_contribution
    return F.when(both > 1e-12, long_excess / F.when(both > 1e-12, both))


def spread_source(long_excess: Column, short_contribution: Column, low: float = 0.35, high: float = 0.65) -> Column:
    share = long_share(long_excess, short_contribution)
    return F.when(share.isNull(), "none").when(share > high, "long").when(share < low, "short").otherwise("both")


def decayed(ic_recent: Column, icir_recent: Column, kept: Column, retention_min: float = 0.5, icir_max: float = 0.2, ic_max: float = 0.01) -> Column:
    """All three: little of the ICIR is kept, the recent ICIR is small and so is the recent mean."""
    return F.coalesce((kept < retention_min) & (F.abs(icir_recent) < icir_max) & (F.abs(ic_recent) < ic_max), F.lit(False))


def dense_gate(mean: Column, icir: Column, significant: Column, least_mean: float = 0.015, least_icir: float = 0.3) -> Column:
    return F.coalesce((F.abs(mean) >= least_mean) & (F.abs(icir) >= least_icir) & significant, F.lit(False))


def sparse_gate(mean: Column, icir: Column, win_rate: Column, payoff_hit: Column, least_mean: float = 0.015, least_icir: float = 0.2, least_win: float = 0.56, least_payoff: float = 0.55) -> Column:
    return F.coalesce((F.abs(mean) >= least_mean) & (F.abs(icir) >= least_icir) & (win_rate >= least_win) & (payoff_hit >= least_payoff), F.lit(False))


def emerging(mean: Column, icir: Column, icir_recent: Column, lift: Column, recent_significant: Column, rising: Column, least_mean: float = 0.015, least_icir: float = 0.3, least_recent: float = 0.35, least_lift: float = 1.5) -> Column:
    """Not through the dense gate as a whole, but of late significant, strong, better than before and rising."""
    whole = (F.abs(mean) >= least_mean) & (F.abs(icir) >= least_icir)
    return F.coalesce(~whole & recent_significant & (F.abs(icir_recent) >= least_recent) & (lift >= least_lift) & rising, F.lit(False))
