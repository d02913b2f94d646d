"""Labels, information coefficients and their statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import timeseries as ts
from ..plans.series import average_ranks, rank_correlation


def forward_return(close: Column, open_: Column | None, n: int) -> Column:
    """Return from the next row's open (or this close) to the close n rows on."""
    entry = F.lead(open_, 1).over(ts.whole()) if open_ is not None else close
    return ts.real(F.lead(close, n).over(ts.whole()) / F.when(entry != 0, entry)) - 1


def ic_series(panel: DataFrame, factor: str, label: str, least: int = 30, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Per date the correlation of factor ranks and label ranks, each ranked among its own values. A section, of the universe's size, is one group."""
    rows = panel.select(*by, F.col(factor).cast("double").alias("_x"), F.col(label).cast("double").alias("_y")).where("_x is not null or _y is not null")
    keys = rows.select(*by).schema.fields
    schema = StructType([*keys, StructField("ic", DoubleType()), StructField("n", LongType())])

    def correlate(section: pa.Table) -> pa.Table:
        """One row, or none, of a section: two numbers for each of its codes."""
        values, known = {}, {}
        for c in ("_x", "_y"):
            known[c] = section.column(c).is_valid().to_numpy()
            values[c] = np.full(len(section), np.nan)
            values[c][known[c]] = average_ranks(section.column(c).drop_null().to_numpy())
        both = known["_x"] & known["_y"]
        n = int(both.sum())
        out = section.select(list(by)).slice(0, 1 if n >= least and n else 0)
        found = [rank_correlation(values["_x"][both], values["_y"][both])] * len(out)
        return out.append_column("ic", pa.array(found, pa.float64())).append_column("n", pa.array([n] * len(out), pa.int64()))

    return rows.groupBy(*by).applyInArrow(correlate, schema)


def joint_ic_series(panel: DataFrame, factor: str, label: str, least: int = 30) -> DataFrame:
    """The same with ranks among the codes that have both."""
    return ic_series(panel.where(F.col(factor).isNotNull() & F.col(label).isNotNull()), factor, label, least)


def prepared(ic: Column, bound: float = 0.3) -> Column:
    return F.when(ic.isNotNull(), F.greatest(F.least(ic, F.lit(bound)), F.lit(-bound)))


def ic_stats(ics: DataFrame, *by: str) -> DataFrame:
    """Mean, deviation, ICIR, t and hit rates. Moments are of the bounded series, hits of the raw one,
    where a correlation within rounding of zero is none."""
    x = prepared(F.col("ic"))
    known = ics.where("ic is not null")
    out = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("ic_mean"), F.stddev_pop(x).alias("ic_std"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("up_rate"), F.avg((F.col("ic") < -1e-12).cast("double")).alias("down_rate"))
    sign = F.when(F.abs("ic_mean") > 1e-12, F.signum("ic_mean")).otherwise(0.0)
    ratio = F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).otherwise(0.0)
    return out.withColumns({"icir": ratio, "t_stat": ratio * F.sqrt("n"), "win_rate": F.when(sign >= 0, F.col("up_rate")).otherwise(F.col("down_rate"))})


def default_lags(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9)), the usual number of lags for n observations."""
    return F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))


def newey_west(ics: DataFrame, lags: int, by: str = "factor") -> DataFrame:
    """t of the mean with Bartlett weights over `lags` lags, by factor."""
    over = Window.partitionBy(by)
    centred = ics.where("ic is not null").select(by, "date", "ic", (F.col("ic") - F.avg("ic").over(over)).alias("e"))
    products = centred.select(by, "ic", *[(F.col("e") * F.lag("e", k).over(over.orderBy("date"))).alias(f"g{k}") for k in range(1, lags + 1)], (F.col("e") * F.col("e")).alias("g0"))
    sums = products.groupBy(by).agg(F.avg("ic").alias("mean"), F.count("*").alias("n"), *[F.coalesce(F.sum(f"g{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(lags + 1)])
    variance = (F.col("g0") + sum((F.col(f"g{k}") * (2 * (1 - k / (lags + 1))) for k in range(1, lags + 1)), F.lit(0.0))) / F.col("n")
    return sums.select(by, "n", "mean", F.when(variance > 0, F.col("mean") / F.sqrt(variance / F.col("n"))).alias("nw_t"))


def ic_decay(panel: DataFrame, factor: str, close: str, open_: str, horizons: list[int], least: int) -> DataFrame:
    """IC statistics for each horizon: the horizons become rows, so that one pass ranks them all."""
    labelled = panel.withColumns({f"h{h}": forward_return(F.col(close), F.col(open_), h) for h in horizons})
    long = labelled.select("date", F.col(factor), F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("label")) for h in horizons])).alias("o")).select("date", factor, "o.horizon", "o.label")
    return ic_stats(ic_series(long, factor, "label", least, ("horizon", "date")), "horizon")


def rank_turnover(panel: DataFrame, factor: str, least: int = 10) -> DataFrame:
    """Per date one less the rank correlation with the code's factor on the panel's row before."""
    both = panel.select("code", "date", F.col(factor).alias("x"), ts.delay(F.col(factor), 1).alias("before"))
    return joint_ic_series(both, "x", "before", least).select("date", (1 - F.col("ic")).alias("turnover"), "n")


def trigger_payoff(panel: DataFrame, factor: str, label: str, least: int = 5) -> DataFrame:
    """Per date the mean label of codes with a positive factor, less that of all codes."""
    known = panel.where(F.col(label).isNotNull())
    hit = F.coalesce(F.col(factor) > 0, F.lit(False))
    daily = known.groupBy("date").agg(F.count_if(hit).alias("n_trigger"), (F.avg(F.when(hit, F.col(label))) - F.avg(label)).alias("edge"))
    return daily.where(F.col("n_trigger") >= least)


def benjamini_hochberg(stats: DataFrame, t: str, alpha: float = 0.05) -> DataFrame:
    """p value (two-sided normal), its place and whether the step-up procedure keeps it. One row for each factor."""
    p = two_sided_p(F.col(t))
    ranked = stats.withColumn("p", p).withColumn("place", F.row_number().over(Window.orderBy("p", "factor")))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    last = F.max(F.when(F.col("p") <= F.col("place") * alpha / F.col("n"), F.col("place"))).over(Window.partitionBy())
    return ranked.withColumn("n", n).withColumn("significant", F.col("place") <= F.coalesce(last, F.lit(0))).drop("n")


def two_sided_p(t: Column) -> Column:
    """2 (1 - Phi(|t|)) by a rational approximation with an error below 1e-7."""
    z = F.abs(t)
    k = 1 / (1 + 0.2316419 * z)
    # Coefficients of the approximation.
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return 2 * F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5 * poly
