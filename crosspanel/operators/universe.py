"""Which codes count on which date: size, liquidity, age, status and what may be traded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crosssection as cs
from ..functions import timeseries as ts


def known_true(x: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(x, F.lit(False))


def conjunction(*masks: Column | None) -> Column:
    """All of the masks that there are; one that is absent (None) says nothing, a null cell is false."""
    present = [known_true(m) for m in masks if m is not None]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def liquidity(amount: Column, window: int = 20, least: int = 10) -> Column:
    return ts.ts_mean(amount, window, least)


def small_cap(cap: Column, amount: Column, lower: float, upper: float, least_amount: float, window: int = 20) -> Column:
    """Between two sizes and traded enough."""
    return conjunction(cap.between(lower, upper), liquidity(amount, window) >= least_amount)


#: Named size bands in currency, (lower, upper); "all" has no bounds and takes every code.
BANDS = {
    "all": (None, None), "small": (30e8, 150e8), "small_mid": (50e8, 300e8), "mid": (100e8, 500e8), "micro": (8e8, 30e8),
    "small_mid_wide": (20e8, 500e8), "micro_small_100": (0.0, 100e8), "micro_30": (0.0, 30e8), "micro_lt30": (0.0, 30e8),
}
SHELL_FLOOR = 8e8


def cap_band(name: str, cap: Column, amount: Column, least_amount: float) -> Column:
    """The band and enough trading; "all" is no restriction at all."""
    low, high = BANDS[name]
    if low is None and high is None:
        return F.lit(True)
    return small_cap(cap, amount, SHELL_FLOOR if low is None else low, high, least_amount)


def cap_unit_band(cap: Column, least: float, most: float, unit: float = 1e8) -> Column:
    """Within an absolute band, bounds included, in units of 100 million."""
    return known_true((cap / unit).between(least, most))


def smallest_share(panel: DataFrame, cap: str, share: float) -> DataFrame:
    """member: on each month's last date, the codes whose average rank by size is in the lowest share; kept until the next such date.

    Dates before the first such date have no members.
    """
    last = F.max("date").over(Window.partitionBy(F.trunc("date", "month")))
    ranked = panel.withColumn("decides", F.col("date") == last).withColumn("rank", cs.cs_rank(F.col(cap)))
    verdict = F.when(F.col("decides"), known_true(F.col("rank") <= share))
    return ranked.withColumn("member", F.coalesce(ts.carried(verdict), F.lit(False))).drop("decides", "rank")


def restandardise(panel: DataFrame, x: str, member: str, share: float = 0.01, clip: float = 3.0, least: int = 2, least_winsor: int = 10) -> DataFrame:
    """panel with the column z. Among the members of a date: clipped at quantiles (from ten values on), z-score
    (0 where all agree), clipped again; null outside and on dates of fewer than `least` members.
    """
    over = cs.section()
    inside = F.when(known_true(F.col(member)), F.col(x))
    n = F.count(inside).over(over)
    low, high = (F.percentile(inside, F.lit(q)).over(over) for q in (share, 1 - share))
    bounded = F.when(n >= least, F.when((n >= least_winsor) & inside.isNotNull(), F.greatest(F.least(inside, high), low)).otherwise(inside))
    std = F.stddev_pop("_b").over(over)
    z = F.when(std >= 1e-12, F.greatest(F.least((F.col("_b") - F.avg("_b").over(over)) / F.when(std >= 1e-12, std), F.lit(clip)), F.lit(-clip))).otherwise(0.0)
    return panel.withColumn("_b", bounded).withColumn("z", F.when(F.col("_b").isNotNull(), z)).drop("_b")


def pairwise(factor: DataFrame, label: DataFrame, mask: DataFrame) -> DataFrame:
    """factor(code, date, x), label(code, date, y) and mask(code, date, ok) on their common cells, null where not ok."""
    joined = factor.join(label, ["code", "date"]).join(mask, ["code", "date"])
    ok = known_true(F.col("ok"))
    return joined.select("code", "date", F.when(ok, F.col("x")).alias("x"), F.when(ok, F.col("y")).alias("y"))


# Rules of trade: each takes columns of a panel row (and of the dimension tables joined to it).


def suspended(close: Column, volume: Column) -> Column:
    return ~known_true((close > 0) & (volume > 0))


def delisted(date: Column, delist_date: Column) -> Column:
    return known_true(date > delist_date)


def old_enough(date: Column, list_date: Column, days: int) -> Column:
    """A code without a listing date passes."""
    return F.coalesce(F.datediff(date, list_date) >= days, F.lit(True))


def flagged_by_name(name: Column) -> Column:
    """Whether a name marks special treatment."""
    return known_true(F.upper(name).contains("ST"))


def trade_rules(panel: DataFrame, list_dates: DataFrame, delist_dates: DataFrame, flags: DataFrame, days: int = 60, strict: bool = True) -> DataFrame:
    """suspended, delisted, special, aged, can_buy and can_sell of each row.

    panel has limit_up, limit_down and their _open forms, which count when `strict`. The dimension tables have one row for each
    code; flags(code, date) has the flagged cells.
    """
    up, down = (f"limit_{d}_open" if strict else f"limit_{d}" for d in ("up", "down"))
    rows = panel.join(list_dates, "code", "left").join(delist_dates, "code", "left").join(flags.select("code", "date", F.lit(True).alias("special")).distinct(), ["code", "date"], "left")
    rows = rows.withColumns({
        "suspended": suspended(F.col("close"), F.col("volume")), "delisted": delisted(F.col("date"), F.col("delist_date")), "special": known_true(F.col("special")), "aged": old_enough(F.col("date"), F.col("list_date"), days),
    })
    return rows.withColumns({"can_buy": ~F.col("suspended") & ~F.col("delisted") & ~F.col("special") & F.col("aged") & ~F.col(up), "can_sell": ~F.col("suspended") & ~F.col(down)})


def score_gate(score: Column, tradable: Column, label: Column, training: bool = False) -> Column:
    """Scores of cells that could be traded and whose label is known; in training all scores pass."""
    return score if training else F.when(known_true(tradable) & label.isNotNull(), score)


def cleaned_reports(reports: DataFrame, bounds: dict[str, tuple[float, float]], order: str, today: Column | None = None) -> DataFrame:
    """The last row by `order` of each (trade_date, code); values out of their bounds become null; rows of the future go."""
    last = F.row_number().over(Window.partitionBy("trade_date", "code").orderBy(F.desc(order)))
    kept = reports.withColumn("_last", last).where("_last = 1").drop("_last").where(F.col("trade_date") <= (F.current_date() if today is None else today))
    return kept.withColumns({c: F.when(F.col(c).between(low, high), F.col(c)) for c, (low, high) in bounds.items()})


def signed_aux(x: Column) -> Column:
    """An auxiliary panel's value: infinities and NaN are null, negative values stay."""
    return ts.real(x)


def coverage_choice(panel: DataFrame, first: str, second: str, share: float = 0.5) -> DataFrame:
    """cap: the first column, where it covers at least `share` of what the second does on the whole panel, else the second; never a mixture."""
    counts = panel.agg(F.count(first).alias("a"), F.count(second).alias("b"))
    return panel.crossJoin(F.broadcast(counts)).withColumn("cap", F.when(F.col("a") >= share * F.col("b"), F.col(first)).otherwise(F.col(second))).drop("a", "b")
