"""Buckets, top lists, turnover, NAV and risk of portfolios of codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crosssection as cs
from ..functions import scalars
from ..functions import timeseries as ts


def top_n(scores: DataFrame, score: str, n: int, allowed: str | None = None) -> DataFrame:
    """The n best allowed codes of each date, ties by code."""
    known = scores.where(F.col(score).isNotNull() & (F.col(allowed) if allowed else F.lit(True)))
    return known.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "code"))).where(F.col("place") <= n)


def top_fraction(scores: DataFrame, score: str, part: float) -> DataFrame:
    known = scores.where(F.col(score).isNotNull())
    ranked = known.withColumns({"place": F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "code")), "_n": F.count(F.lit(1)).over(cs.section())})
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * part))).drop("_n")


def turnover(holdings: DataFrame, dates: DataFrame) -> DataFrame:
    """For each date the codes that came and went, over twice the codes of either date; 1 at the start.

    holdings(date, code); dates(date): all dates, in the order of holding.
    """
    steps = dates.withColumn("next", F.lead("date").over(Window.orderBy("date")))  # one row for each date
    now = holdings.select("date", "code", F.lit(1).alias("new"), F.lit(0).alias("old"))
    before = holdings.join(F.broadcast(steps), "date").where("next is not null").select(F.col("next").alias("date"), "code", F.lit(0).alias("new"), F.lit(1).alias("old"))
    both = now.union(before).groupBy("date", "code").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    sums = both.groupBy("date").agg(F.sum("new").alias("held"), F.count_if(F.expr("new = 1 and old = 0")).alias("bought"), F.count_if(F.expr("new = 0 and old = 1")).alias("sold"), F.sum("old").alias("was"), F.count("*").alias("either"))
    return sums.select("date", "held", "bought", "sold", F.when(F.col("was") == 0, 1.0).otherwise((F.col("bought") + F.col("sold")) / (2 * F.col("either"))).alias("turnover"))


def bucket_returns(panel: DataFrame, score: str, label: str, n: int, allowed: str | None = None) -> DataFrame:
    """Mean label by date and bucket; buckets are formed from allowed codes."""
    base = panel.where(F.col(allowed)) if allowed else panel
    return base.withColumn("bucket", cs.buckets(F.col(score), n)).where("bucket is not null").groupBy("date", "bucket").agg(F.avg(label).alias("ret"), F.count("*").alias("n"))


def nav(returns: DataFrame, by: str) -> DataFrame:
    """Compounded value; a missing return counts as none."""
    over = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return returns.withColumn("nav", F.exp(F.sum(F.ln(1 + F.coalesce("ret", F.lit(0.0)))).over(over)))


def period_returns(values: DataFrame, by: str) -> DataFrame:
    """ret of each step of values(by, date, nav); the first one against a value of 1."""
    before = F.lag("nav").over(Window.partitionBy(by).orderBy("date"))
    return values.withColumn("ret", F.col("nav") / F.coalesce(before, F.lit(1.0)) - 1)


def risk_metrics(values: DataFrame, by: str, per_year: float, benchmark=None, risk_free: float = 0.0) -> DataFrame:
    """Return and risk of values(by, date, nav), which hold one track for each `by`; benchmark: the value of `by` that others are held against.

    Geometric annual return over the changes, deviation of changes (n - 1) by year, Sharpe and Sortino ratios (the latter over the
    deviation of falls; 0 falls with some rise have none), deepest fall from the running peak, Calmar ratio, information
    ratio, share of rising steps (the first counts against 1) and of steps above the benchmark.
    """
    over = Window.partitionBy(by).orderBy("date")
    peak = F.max("nav").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = period_returns(values.where("nav is not null").select(by, "date", "nav"), by).withColumns({"change": F.col("nav") / F.lag("nav").over(over) - 1, "drawdown": F.col("nav") / peak - 1})
    if benchmark is not None:
        other = steps.where(F.col(by) == F.lit(benchmark)).select("date", F.col("change").alias("bench_change"), F.col("ret").alias("bench_ret"))
        steps = steps.join(other, "date", "left")  # one row for each date
    else:
        steps = steps.withColumns({"bench_change": F.lit(None).cast("double"), "bench_ret": F.lit(None).cast("double")})
    excess = F.col("change") - F.col("bench_change")
    falls = F.when(F.col("change") < -1e-12, F.col("change"))
    root, own = per_year**0.5, F.lit(True) if benchmark is None else F.col(by) != F.lit(benchmark)
    sums = steps.groupBy(by).agg(
        F.count("change").alias("n"), F.exp(F.sum(F.ln(1 + F.when(F.col("change") > -1, F.col("change"))))).alias("growth"), (F.stddev_samp("change") * root).alias("volatility"),
        F.count(falls).alias("n_falls"), (F.stddev_samp(falls) * root).alias("fall_deviation"), F.min("drawdown").alias("max_drawdown"),
        (F.avg(excess) / F.when(F.stddev_samp(excess) > 0, F.stddev_samp(excess)) * root).alias("information"),
        F.avg((F.col("ret") > 1e-12).cast("double")).alias("win_rate"), F.avg((F.col("ret") - F.coalesce("bench_ret", F.lit(0.0)) > 1e-12).cast("double")).alias("beat"),
    )
    annual = F.when(F.col("n") > 0, F.pow("growth", per_year / F.col("n")) - 1)
    over_positive = lambda a, b: F.when(b > 0, a / F.when(b > 0, b))
    return sums.select(
        by, F.col("n").alias("periods"), annual.alias("annual_return"), "volatility", over_positive(annual - risk_free, F.col("volatility")).alias("sharpe"),
        over_positive(annual - risk_free, F.col("fall_deviation")).alias("sortino"), F.abs("max_drawdown").alias("max_drawdown"), over_positive(annual, F.abs("max_drawdown")).alias("calmar"),
        F.when(own & F.lit(benchmark is not None), F.col("information")).alias("information_ratio"), "win_rate", F.when(own & F.lit(benchmark is not None), F.col("beat")).alias("beat_rate"),
    )


def inverse_volatility(panel: DataFrame, ret: str, window: int) -> DataFrame:
    """Weights of each date's codes in proportion to one over their trailing deviation; equal weights on dates where no code has one."""
    inverse = panel.withColumn("sigma", ts.ts_std(F.col(ret), window)).withColumn("inv", 1 / F.when(F.col("sigma") > 1e-12, F.col("sigma")))
    total = F.sum("inv").over(cs.section())
    weight = F.when(total > 0, F.col("inv") / total).when(total.isNull(), 1 / F.count(F.lit(1)).over(cs.section()))
    return inverse.withColumn("weight", weight).where("weight is not null")


def capped_weights(weights: DataFrame, cap: float) -> DataFrame:
    """Weights of each date (which sum to 1) with none over the cap, or over an equal share if that is more; what is cut goes to the others in proportion.

    In falling order the first k codes are at the limit, where k is the least number for which the others, scaled up to what is left, stay within it: one pass, no repetition.
    """
    date = Window.partitionBy("date")
    falling = date.orderBy(F.desc("weight"), "code")
    out = weights.withColumns({
        "_limit": F.greatest(F.lit(cap), 1 / F.count(F.lit(1)).over(date)), "_k": F.row_number().over(falling) - 1,
        "_rest": F.sum("weight").over(date.orderBy("weight", F.desc("code")).rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    scale = F.when(F.col("_rest") > 0, (1 - F.col("_k") * F.col("_limit")) / F.when(F.col("_rest") > 0, F.col("_rest")))
    fits = F.col("weight") * F.col("_scale") <= F.col("_limit") * (1 + 1e-12)
    out = out.withColumn("_scale", scale).withColumn("_first", F.min(F.when(fits, F.col("_k"))).over(date))
    chosen = F.max(F.when(F.col("_k") == F.col("_first"), F.col("_scale"))).over(date)
    weight = F.when(F.coalesce(F.col("_k") < F.col("_first"), F.lit(True)), F.col("_limit")).otherwise(F.col("weight") * F.col("_chosen"))
    return out.withColumn("_chosen", chosen).withColumn("weight", weight).drop("_limit", "_k", "_rest", "_scale", "_first", "_chosen")


def constrained_track(periods: DataFrame, n: int, limit: float = 1.0) -> DataFrame:
    """Holdings of each track period by period: what can't be sold stays, at most a share `limit` is exchanged.

    periods(track, date, code, score, can_buy, can_sell, ret). Only a code that was once among the n best
    that can be bought is ever held, so other rows end before the walk (but for one of each date).
    A track's rows pass one task in the order of dates, of which it holds one at a time; the state is a set of at most n codes.
    """
    known = periods.where("date is not null").select("track", "date", "code", F.nanvl("score", F.lit(None)).alias("score"), "can_buy", "can_sell", F.nanvl("ret", F.lit(None)).alias("ret"))
    best = Window.partitionBy("track", "date").orderBy(F.desc("_open"), F.desc_nulls_last("score"), "code")
    placed = known.withColumn("_open", F.col("can_buy") & F.col("score").isNotNull()).withColumn("_place", F.row_number().over(best))
    so_far = Window.partitionBy("track", "code").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = placed.withColumn("_met", F.max(F.col("_open") & (F.col("_place") <= n)).over(so_far)).where("_met or _place = 1").drop("_open", "_place", "_met")

    def step(day: pd.DataFrame, held: set[str]) -> tuple[set[str], tuple]:
        scored = day[day["score"].notna()]
        target = scored[scored["can_buy"] | scored["code"].isin(held)]["code"].head(n).tolist()
        if target:
            can_sell = set(day.loc[day["can_sell"], "code"])
            leaving = [c for c in reversed(scored["code"].tolist()) if c in held and c not in target and c in can_sell]
            if held:
                leaving = leaving[: int(np.floor(limit * n))]
            kept = held - set(leaving)
            room = max(0, n - len(kept))
            new = [c for c in target if c not in kept][:room]
            held = kept | set(new)
        else:
            leaving, new = [], []
        known = day[day["code"].isin(held)]["ret"]
        return held, (day["track"].iloc[0], day["date"].iloc[0], len(held), len(new), len(leaving), float(known.mean()) if known.notna().any() else 0.0)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, held = None, set()
        for day in _days(batches):
            if day["track"].iloc[0] != track:
                track, held = day["track"].iloc[0], set()
            held, row = step(day, held)
            yield pa.RecordBatch.from_pylist([dict(zip(_TRACK.names, row, strict=True))], schema=_TRACK)

    return met.repartition("track").sortWithinPartitions("track", "date", F.desc_nulls_last("score"), "code").mapInArrow(walk, "track string, date date, held long, bought long, sold long, ret double")


_TRACK = pa.schema([("track", pa.string()), ("date", pa.date32()), ("held", pa.int64()), ("bought", pa.int64()), ("sold", pa.int64()), ("ret", pa.float64())])


def _days(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of each track and date, of batches sorted by them."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        keys = list(zip(batch.column("track").to_pylist(), batch.column("date").to_pylist(), strict=True))
        edges = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for a, b in zip([0, *edges], [*edges, len(keys)] if keys else [], strict=False):
            if held and keys[a] != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(a, b - a).to_pandas())
            last = keys[a]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def cost_of(turnover_column: Column, **rates: float) -> Column:
    return scalars.trade_cost(turnover_column, **rates)
