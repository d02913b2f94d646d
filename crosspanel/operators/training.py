"""What surrounds a model that is trained again and again: folds, weights of samples and models, combination of scores, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crosssection as cs


def folds(dates: DataFrame, window: int, validation: int, embargo: int = 0, hold: int = 0, every: int = 1) -> DataFrame:
    """One row for each date that has a full window before it: the validation span right before it, the training span before that.

    The last `embargo` training dates are dropped, and those whose label, `hold` dates long, reaches into validation (purged). `retrains`: every so many dates.
    dates(date) is a calendar, of which one ordered pass numbers the rows.
    """
    at = Window.orderBy("date")
    back = lambda n: F.lag("date", n).over(at)
    dropped = max(embargo, hold)
    rows = dates.select("date", F.row_number().over(at).alias("k"), back(validation).alias("validation_from"), back(1).alias("validation_to"), back(validation + window).alias("train_from"), back(validation + 1 + dropped).alias("train_to"))
    known = rows.where(F.col("train_from").isNotNull())
    return known.select("date", "train_from", "train_to", "validation_from", "validation_to", ((F.col("k") - window - validation - 1) % every == 0).alias("retrains"))


def embargo_periods(hold_days: int, dates: DataFrame, sample: int = 20) -> DataFrame:
    """One row: how many steps of the calendar a label of `hold_days` covers, by the median gap of the first dates; one at least."""
    gaps = dates.select("date", F.row_number().over(Window.orderBy("date")).alias("k"), F.datediff("date", F.lag("date").over(Window.orderBy("date"))).alias("gap")).where(F.col("k") <= sample)
    return gaps.agg(F.greatest(F.lit(1), F.ceil(hold_days / F.percentile("gap", F.lit(0.5)))).cast("int").alias("periods"))


def overlap_weights(dates: DataFrame, hold_days: int, next_date: Column | None = None, floor: float = 0.1, share: float = 0.5) -> DataFrame:
    """weight of each date's samples: 1 less `share` of the part of its label's days that the next date's label covers, at least `floor`.

    next_date: the date to predict, which the last date's label may overlap with; without it the last date has weight 1. All have 1 without a hold period.
    """
    if hold_days <= 0:
        return dates.select("date", F.lit(1.0).alias("weight"))
    following = F.lead("date").over(Window.orderBy("date"))
    gap = F.datediff(following if next_date is None else F.coalesce(following, next_date), "date")
    overlap = F.coalesce(F.greatest(hold_days - gap, F.lit(0)) / hold_days, F.lit(0.0))
    return dates.select("date", F.greatest(F.lit(floor), 1 - share * overlap).alias("weight"))


def universe_weights(panel: DataFrame, weight: str) -> DataFrame:
    """Weights times the share of the date's rows in those of the fullest date."""
    counts = panel.groupBy("date").agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    return panel.join(F.broadcast(counts.crossJoin(F.broadcast(most))), "date").withColumn(weight, F.col(weight) * F.col("_n") / F.col("_most")).drop("_n", "_most")  # one row for each date


def rank_labels(y: str) -> Column:
    """0, 1, 2, ... by value on a date, ties by code."""
    known = Window.partitionBy("date", F.col(y).isNull()).orderBy(y, "code")
    return F.when(F.col(y).isNotNull(), F.row_number().over(known) - 1).cast("int")


def variance_aligned(panel: DataFrame, x: str, target: float = 1.0, least: int = 30) -> DataFrame:
    """x scaled so that all its values together have the target deviation; as it is where there are too few or they agree."""
    whole = panel.agg(F.stddev_pop(x).alias("_s"), F.count(x).alias("_n"))
    scale = F.when((F.col("_n") >= least) & (F.col("_s") > 1e-12), target / F.col("_s")).otherwise(1.0)
    return panel.crossJoin(F.broadcast(whole)).withColumn(x, F.col(x) * scale).drop("_s", "_n")


def pool_standardised(panel: DataFrame, x: str, member: Column, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """z: of pool members of each date, clipped at quantiles (from three values on), then standardised (0 where they agree)."""
    over = cs.section()
    inside = F.when(F.coalesce(member, F.lit(False)), F.col(x))
    bounds = [F.percentile(inside, F.lit(q)).over(over) for q in (low, high)]
    clipped = F.when((F.count(inside).over(over) >= 3) & inside.isNotNull(), F.least(F.greatest(inside, bounds[0]), bounds[1])).otherwise(inside)
    std = F.stddev_pop("_c").over(over)
    z = F.when((F.count("_c").over(over) >= 2) & (std > 1e-12), (F.col("_c") - F.avg("_c").over(over)) / F.when(std > 1e-12, std)).otherwise(0.0)
    return panel.withColumn("_c", clipped).withColumn("z", F.when(F.col("_c").isNotNull(), z)).drop("_c")


def positive_weights(value: Column, *by: str, temperature: float = 0.5) -> Column:
    """Shares of the positive values; where none is positive, the softmax of all. Null counts as 0."""
    over = Window.partitionBy(*by)
    v = F.coalesce(value, F.lit(0.0))
    positive = F.when(v > 1e-12, v).otherwise(0.0)
    total = F.sum(positive).over(over)
    soft = F.exp((v - F.max(v).over(over)) / temperature)
    return F.when(total > 0, positive / F.when(total > 0, total)).otherwise(soft / F.sum(soft).over(over))


def softmax_of_recent(ics: DataFrame, last: int = 6, temperature: float = 0.5) -> DataFrame:
    """Per date the softmax over factors of their mean coefficient on the `last` dates before; equal without any."""
    past = Window.partitionBy("factor").orderBy("date").rowsBetween(-last, -1)
    means = ics.select("factor", "date", F.coalesce(F.avg("ic").over(past), F.lit(0.0)).alias("m"))
    over = Window.partitionBy("date")
    e = F.exp((F.col("m") - F.max("m").over(over)) / temperature)
    return means.withColumn("e", e).select("factor", "date", (F.col("e") / F.sum("e").over(over)).alias("weight"))


def combined(scores: DataFrame, weights: dict[str, float], rank: bool = False) -> DataFrame:
    """score: weighted mean of z-scores (or of ranks) of the named columns, over the weights of those a row has."""
    parts = {n: cs.cs_rank(F.col(n)) if rank else cs.cs_zscore(F.col(n), None) for n in weights}
    made = scores.withColumns({f"_{n}": x for n, x in parts.items()})
    total = sum((F.when(F.col(f"_{n}").isNotNull(), F.lit(w)).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(f"_{n}") * w, F.lit(0.0)) for n, w in weights.items()), F.lit(0.0))
    return made.withColumn("score", F.when(total > 0, value / F.when(total > 0, total))).drop(*[f"_{n}" for n in weights])


def drift(ics: DataFrame, limit: float = 3.0, least: int = 5) -> DataFrame:
    """z of each coefficient against all earlier ones of its factor, from `least` on; flagged beyond the limit."""
    past = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    rows = ics.select("factor", "date", "ic", F.count("ic").over(past).alias("n"), F.avg("ic").over(past).alias("m"), F.stddev_pop("ic").over(past).alias("s"))
    z = F.when((F.col("n") >= least) & (F.col("s") > 1e-12), (F.col("ic") - F.col("m")) / F.when(F.col("s") > 1e-12, F.col("s")))
    return rows.select("factor", "date", z.alias("drift_z"), F.coalesce(F.abs(z) > limit, F.lit(False)).alias("flagged"))


def deflated_benchmark(trials: int, n: Column) -> Column:
    """The largest Sharpe ratio (per observation) to expect of so many independent tries without skill."""
    import math

    if trials <= 1:
        return F.lit(0.0)
    log = math.log(trials)
    # Fixed value: Euler's constant.
    return F.sqrt(2 * log / (n - 1)) * (1 - 0.5772156649015329 / (2 * log))


def overfitting_probability(chosen: DataFrame, edge: float = 1e-6) -> DataFrame:
    """One row from `overfitting`: the share of trials that are overfit, its logit (the share held off 0 and 1), and the number of trials; shares are null without any."""
    share = F.avg(F.col("overfit").cast("double"))
    held = F.least(F.greatest(share, F.lit(edge)), F.lit(1 - edge))
    return chosen.agg(F.count("*").alias("trials"), share.alias("pbo"), F.when(share.isNotNull(), F.ln(held / (1 - held))).alias("logit_pbo"))


def overfitting(trials: DataFrame) -> DataFrame:
    """Per trial the best strategy within the sample (ties by name) and its rank outside, over the number of strategies plus one; overfit at one half or less.

    trials(trial, strategy, inside, outside); a trial needs two strategies with both values.
    """
    by = Window.partitionBy("trial")
    both = F.col("inside").isNotNull() & F.col("outside").isNotNull()
    rows = trials.withColumns({"n": F.count("*").over(by), "known": F.count_if(both).over(by), "rank": F.row_number().over(by.orderBy(F.asc_nulls_last("outside"), "strategy"))})
    best = F.row_number().over(by.orderBy(F.desc(F.when(both, F.col("inside"))), "strategy"))
    chosen = rows.where("known >= 2").withColumn("best", best).where("best = 1")
    relative = F.col("rank") / (F.col("n") + 1)
    return chosen.select("trial", "strategy", relative.alias("relative_rank"), (relative <= 0.5).alias("overfit"))
