"""Functions over all codes of one date, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def section(*by: str) -> WindowSpec:
    return Window.partitionBy(*(by or ("date",)))


def cs_rank(x: Column, *by: str) -> Column:
    """Average rank over the number of values; nulls stay null."""
    group = [*(by or ("date",)), x.isNull()]
    order = Window.partitionBy(*group).orderBy(x)
    ties = Window.partitionBy(*group, x)
    return F.when(x.isNotNull(), (F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy(*group)))


def average_rank(x: Column, *by: str) -> Column:
    group = [*(by or ("date",)), x.isNull()]
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*group).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, x)) - 1) / 2)


def winsorize(x: Column, share: float = 0.01, *by: str) -> Column:
    over = section(*by)
    low, high = F.percentile(x, F.lit(share)).over(over), F.percentile(x, F.lit(1 - share)).over(over)
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def cs_zscore(x: Column, clip: float | None = 3.0, *by: str) -> Column:
    """Population z-score, null where all values agree."""
    over = section(*by)
    std = F.stddev_pop(x).over(over)
    z = (x - F.avg(x).over(over)) / F.when(std > 1e-12, std)
    return z if clip is None else F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))


def demean(x: Column, group: str, least: int = 2) -> Column:
    """Less the mean of the group on the date; groups of fewer than `least` stay as they are."""
    over = section("date", group)
    return F.when(F.count(x).over(over) >= least, x - F.avg(x).over(over)).otherwise(x)


def exclude_self_mean(x: Column, group: str, least: int = 5) -> Column:
    over = section("date", group)
    n = F.count(x).over(over)
    return F.when(n >= least, (F.sum(x).over(over) - x) / (n - 1))


def scale(x: Column) -> Column:
    total = F.sum(F.abs(x)).over(section())
    return x / F.when(total > 0, total)


def row_max(x: Column) -> Column:
    return F.max(x).over(section())


def row_min(x: Column) -> Column:
    return F.min(x).over(section())


def buckets(score: Column, n: int, least: int | None = None, tie: str = "code", min_stocks: int = 1) -> Column:
    """1 to n by rank, ties by code; null on dates with fewer than `least` scores (n * min_stocks unless given)."""
    known = Window.partitionBy("date", score.isNull())
    place = F.row_number().over(known.orderBy(score, tie))
    count = F.count(F.lit(1)).over(known)
    return F.when(score.isNotNull() & (count >= (least or n * min_stocks)), F.greatest(F.lit(1), F.ceil((place - 1) * n / F.greatest(count - 1, F.lit(1))))).cast("int")
