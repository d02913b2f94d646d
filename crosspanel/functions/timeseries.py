"""Trailing-window functions over one code's rows in date order, as Column builders.

They expect the dense grid of `crosspanel.sources.panel`: a day without a trade is a row of nulls,
so a frame of w rows is w calendar steps. Nulls are skipped; a result needs `least` values in its
frame (default: a share of the window that depends on the function). No result is NaN.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BY, ORDER = "code", "date"


def whole(by: str = BY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def frame(w: int, by: str = BY, order: str = ORDER) -> WindowSpec:
    """The last w rows, the current one included."""
    return whole(by, order).rowsBetween(-(w - 1), Window.currentRow)


def share(w: int, part: float, floor: int = 1) -> int:
    return max(floor, int(w * part))


def real(x: Column) -> Column:
    """Null for NaN and infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def guarded(result: Column, counted: Column, w: int, least: int) -> Column:
    over = frame(w)
    return F.when(F.count(counted).over(over) >= least, real(result.over(over)))


def delay(x: Column, k: int) -> Column:
    return F.lag(x, k).over(whole())


def delta(x: Column, k: int) -> Column:
    return x - delay(x, k)


def ts_sum(x: Column, w: int, least: int | None = None) -> Column:
    return guarded(F.sum(x), x, w, least or share(w, 0.7))


def ts_mean(x: Column, w: int, least: int | None = None) -> Column:
    return guarded(F.avg(x), x, w, least or share(w, 0.5))


def ts_std(x: Column, w: int, least: int | None = None) -> Column:
    return guarded(F.stddev_samp(x), x, w, least or share(w, 0.5, 2))


def ts_max(x: Column, w: int, least: int | None = None) -> Column:
    return guarded(F.max(x), x, w, least or share(w, 0.7))


def ts_min(x: Column, w: int, least: int | None = None) -> Column:
    return guarded(F.min(x), x, w, least or share(w, 0.7))


def ts_prod(x: Column, w: int, least: int | None = None) -> Column:
    """Product; over positive values only it is the exponential of a sum of logarithms."""
    over = frame(w)
    positive = F.min(x).over(over) > 0
    logs = F.exp(F.sum(F.when(x > 0, F.ln(x))).over(over))
    return F.when(F.count(x).over(over) >= (least or share(w, 0.7)), real(F.when(positive, logs).otherwise(F.product(x).over(over))))


def _pairs(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.lit(1))


def ts_corr(x: Column, y: Column, w: int, least: int | None = None) -> Column:
    """From the moments of the pairs, so that a constant side gives null and no division by zero."""
    over, pair = frame(w), _pairs(x, y)
    spread = F.stddev_samp(F.when(pair == 1, x)).over(over) * F.stddev_samp(F.when(pair == 1, y)).over(over)
    enough = F.count(pair).over(over) >= (least or share(w, 0.7, 2))
    return F.when(enough & (spread > 1e-12), F.covar_samp(x, y).over(over) / F.when(spread > 1e-12, spread))


def ts_cov(x: Column, y: Column, w: int, least: int | None = None) -> Column:
    return guarded(F.covar_samp(x, y), _pairs(x, y), w, least or share(w, 0.7, 2))


def ts_rank(x: Column, w: int, least: int | None = None) -> Column:
    """Rank of the current value among the frame's (average of ties) over their number."""
    seen = F.collect_list(x).over(frame(w))
    below, equal = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(seen) >= (least or share(w, 0.7, 2))), (below + (equal + 1) / 2) / F.size(seen))


def ts_quantile(x: Column, w: int, q: float) -> Column:
    return guarded(F.percentile(x, F.lit(q)), x, w, share(w, 0.7, 2))


def _position() -> Column:
    return F.row_number().over(whole())


def _full(w: int) -> Column:
    return F.count(F.lit(1)).over(frame(w)) == w


def _argext(x: Column, w: int, pick) -> Column:
    """Place of the first extreme value in a frame of w rows, 0 for the oldest."""
    over = frame(w)
    places = F.collect_list(F.struct(x.alias("x"), F.lit(0).alias("pad"))).over(over)
    extreme = pick(x).over(over)
    return F.when(_full(w) & extreme.isNotNull(), (F.array_position(F.transform(places, lambda s: s["x"] == extreme), F.lit(True)) - 1).cast("double"))


def ts_argmax(x: Column, w: int) -> Column:
    return _argext(x, w, F.max)


def ts_argmin(x: Column, w: int) -> Column:
    return _argext(x, w, F.min)


def highday(x: Column, w: int) -> Column:
    """1 where the highest value is today's."""
    return w - ts_argmax(x, w)


def lowday(x: Column, w: int) -> Column:
    return w - ts_argmin(x, w)


def weighted_mean(x: Column, weights: list[float]) -> Column:
    """weights: of the oldest row first; null if any row of the window is null."""
    total = sum(weights)
    return reduce(lambda a, b: a + b, [F.lag(x, k).over(whole()) * (weight / total) for k, weight in enumerate(reversed(weights))])


def decay_linear(x: Column, w: int) -> Column:
    return weighted_mean(x, [float(k) for k in range(1, w + 1)])


def wma(x: Column, w: int, base: float = 0.9) -> Column:
    return weighted_mean(x, [base**k for k in range(w - 1, -1, -1)])


def _on_time(result, x: Column, w: int, place: Column) -> Column:
    return F.when((F.count(x).over(frame(w)) == w) & _full(w), real(result(x, place).over(frame(w))))


def ts_slope(x: Column, w: int, place: Column) -> Column:
    """Slope of x on time; place: the row's number in its code, a plain column (`with_position`)."""
    return _on_time(F.regr_slope, x, w, place)


def ts_rsquare(x: Column, w: int, place: Column) -> Column:
    varied = F.max(x).over(frame(w)) > F.min(x).over(frame(w))
    return F.when(varied, _on_time(F.regr_r2, x, w, place))


def ts_resi(x: Column, w: int, place: Column) -> Column:
    return x - (_on_time(F.regr_intercept, x, w, place) + _on_time(F.regr_slope, x, w, place) * place)


def with_position(df, name: str = "place"):
    return df.withColumn(name, _position().cast("double"))


def ts_count(condition: Column, w: int) -> Column:
    """How often the condition held; a comparison with null counts as false."""
    held = F.coalesce(condition, F.lit(False)).cast("double")
    return guarded(F.sum(held), held, w, share(w, 0.7))


def sumif(x: Column, w: int, condition: Column) -> Column:
    return ts_sum(F.when(F.coalesce(condition, F.lit(False)), x).otherwise(0.0), w)


def ewm_sma(x: Column, n: int, m: int) -> Column:
    """Recursive mean with weight m / n; the weight of what is known fades over null rows too.

    Read from so many rows that what is older would weigh less than 1e-12 even if half of the rows are
    null; where all of them are null the last known value stands.
    """
    alpha = m / n
    rows = 2 * math.ceil(math.log(1e-12) / math.log(1 - alpha))
    seen = F.collect_list(F.struct(x.alias("x"))).over(whole().rowsBetween(1 - rows, Window.currentRow))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("old"))

    def step(state: Column, row: Column) -> Column:
        old = state["old"] * (1 - alpha)
        value = F.when(row["x"].isNull(), state["y"]).when(state["y"].isNull(), row["x"]).otherwise((old * state["y"] + alpha * row["x"]) / (old + alpha))
        return F.struct(value.alias("y"), F.when(row["x"].isNull(), old).otherwise(F.lit(1.0)).alias("old"))

    return F.coalesce(F.aggregate(seen, start, step, lambda s: s["y"]), carried(x))


def forward_sum(x: Column, w: int) -> Column:
    return F.sum(x).over(whole().rowsBetween(0, w - 1))


def carried(x: Column, rows: int | None = None) -> Column:
    """The last known value, at most so many rows old."""
    return F.last(x, ignorenulls=True).over(whole().rowsBetween(Window.unboundedPreceding if rows is None else -rows, Window.currentRow))


def emax(a: Column, b: Column) -> Column:
    """The larger; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def emin(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def safe_div(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return real(a / F.when(b + eps != 0, b + eps))


def ratio(a: Column, b: Column) -> Column:
    return real(a / F.when(b != 0, b))


def ts_skew(x: Column, w: int, least: int | None = None) -> Column:
    """Skewness with the adjustment for small samples; null for constant windows and fewer than three values."""
    over = frame(w)
    n = F.count(x).over(over).cast("double")
    enough = (n >= max(3, least or share(w, 0.7))) & (F.stddev_pop(x).over(over) > 1e-12)
    return F.when(enough, real(F.skewness(x).over(over) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)))
