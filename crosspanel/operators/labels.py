"""Training labels and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crosssection as cs
from ..functions import timeseries as ts


def ordinal_rank(y: str) -> Column:
    """Rank from 0 to 1 on a date, ties by code; null labels have none."""
    known = Window.partitionBy("date", F.col(y).isNull())
    n = F.count(F.lit(1)).over(known)
    return F.when(F.col(y).isNotNull(), (F.row_number().over(known.orderBy(y, "code")) - 1) / F.greatest(n - 1, F.lit(1)))


def zscore(y: str) -> Column:
    over = cs.section()
    std = F.stddev_pop(y).over(over)
    return F.when(F.col(y).isNotNull(), F.when(std > 1e-12, (F.col(y) - F.avg(y).over(over)) / std).otherwise(0.0))


def label_modes(panel: DataFrame, y: str, top: float = 0.4, slope: float = 0.25) -> DataFrame:
    """cs_rank, cs_zscore, top (z of the best share, else 0) and soft: 0 at the edge of the best share, 1 at the top, -slope at the bottom."""
    base = panel.withColumns({"cs_rank": ordinal_rank(y), "cs_zscore": zscore(y)})
    r, edge = F.col("cs_rank"), 1 - top
    return base.withColumns({"top_z": F.when(r >= edge, F.col("cs_zscore")).when(r.isNotNull(), 0.0), "soft_long": F.when(r >= edge, (r - edge) / top).when(r.isNotNull(), (r - edge) / edge * slope)})


def sample_weights(rank: Column, top: float = 0.4, bottom: float = 0.25, transition: float = 0.1, middle: float = 0.6) -> dict[str, Column]:
    """Weights that favour high ranks (by a step or a smooth step) or both tails."""
    edge = 1 - top
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rank - (edge - transition)) / (2 * transition)))
    smooth = t * t * (3 - 2 * t)
    return {
        "step_weight": F.when(rank >= edge, 1.0).when(rank.isNotNull(), bottom),
        "smooth_weight": F.when(rank.isNotNull(), bottom + (1 - bottom) * smooth),
        "tail_weight": F.when(rank.isNotNull(), middle + (1 - middle) * F.pow(2 * F.abs(rank - 0.5), F.lit(2.0))),
    }


def triple_barrier(panel: DataFrame, hold: int, vol_window: int = 20, upper: float = 2.0, lower: float = 2.0) -> DataFrame:
    """barrier: 1, -1 or 0 for which of entry * (1 +- k sigma) a code's closes touch first in `hold` rows.

    Entry is the next row's open. The upper barrier wins a tie; a path without closes is 0.
    """
    sigma = ts.ts_std(F.col("ret"), vol_window)
    path = F.collect_list(F.struct(F.col("close").alias("c"))).over(ts.whole().rowsBetween(1, hold))
    base = panel.withColumns({"sigma": sigma, "entry": F.lead("open", 1).over(ts.whole()), "path": path})
    above = F.array_position(F.transform("path", lambda s: F.coalesce(s["c"] >= F.col("entry") * (1 + upper * F.col("sigma")), F.lit(False))), F.lit(True))
    below = F.array_position(F.transform("path", lambda s: F.coalesce(s["c"] <= F.col("entry") * (1 - lower * F.col("sigma")), F.lit(False))), F.lit(True))
    label = F.when((above > 0) & ((below == 0) | (above <= below)), 1).when(below > 0, -1).otherwise(0)
    return base.withColumn("barrier", F.when(F.col("entry").isNotNull() & F.col("sigma").isNotNull(), label)).drop("path", "sigma", "entry")
