"""Regressions on the market with decaying weights, and the risk styles built from them.

A sum with weights that halve every h rows is a running sum of values scaled up by 2^(row / h), scaled back by the row's own factor,
so a frame of any length costs one pass. Rows are numbered within blocks of REACH halvings; a block also holds the rows of the
block before it as history, so factors stay within 2^-64 and 2^64 and what is cut off weighs less than 2^-64 of the newest row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import crosssection as cs
from ..functions import timeseries as ts
from ..plans import series

REACH = 64
#: Rows of the window and of the half-life of market regression, and of momentum with the rows that it skips.
BETA_WINDOW, BETA_HALFLIFE = 252, 63
MOMENTUM_WINDOW, MOMENTUM_HALFLIFE, MOMENTUM_SKIP = 240, 60, 20
LIQUIDITY_WINDOWS = (63, 252)
STYLES = ("size", "nonlin_size", "beta", "res_vol", "momentum", "liquidity")


def decayed_sums(panel: DataFrame, values: dict[str, Column], halflife: float, by: str = ts.BY, order: str = ts.ORDER) -> DataFrame:
    """The panel with a column for each value: the sum over a code's rows up to this one of value * 0.5^(rows since / halflife); null counts as 0."""
    length = int(REACH * halflife)
    rows = panel.withColumns({**{n: F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in values.items()}, "_at": F.row_number().over(ts.whole(by, order)) - 1, "_of": F.count(F.lit(1)).over(Window.partitionBy(by))})
    own = F.floor(F.col("_at") / length)
    last = F.floor((F.col("_of") - 1) / length)
    # A row is history in the next block too, where there is one.
    blocks = rows.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, F.least(own + 1, last))))
    over = Window.partitionBy(by, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scale = F.pow(F.lit(2.0), (F.col("_at") - F.col("_block") * length) / halflife)
    summed = blocks.withColumns({n: F.sum(F.col(n) * scale).over(over) / scale for n in values})
    return summed.where(F.col("_block") == F.col("_own")).drop("_at", "_of", "_own", "_block")


def market_regression(panel: DataFrame, ret: str, market: str, halflife: float = BETA_HALFLIFE, window: int = BETA_WINDOW) -> DataFrame:
    """The panel with beta and hsigma: slope and residual deviation of the regression of a code's return on the market's, with decaying weights.

    Only rows with both returns count. Null where fewer than half of the window's rows have both (so that a code that left keeps no old value), or where the market didn't move.
    """
    rows = panel.withColumns({"_r": ts.real(F.col(ret)), "_m": ts.real(F.col(market))})
    return series.with_series(rows, _regression("_r", "_m", halflife, window, "hsigma")).drop("_r", "_m")


def _regression(ret: str, market: str, halflife: float, window: int, deviation: str) -> dict:
    return {n: ("decayedregression", (ret, market), (halflife, window, k)) for n, k in (("beta", False), (deviation, True))}


def halflife_mean(panel: DataFrame, value: Column, window: int, halflife: float, name: str, least: float = 0.5) -> DataFrame:
    """The panel with the mean of the last `window` rows' values, weights halving every `halflife` rows; null where the known values have less than the share `least` of all the weight."""
    rows = panel.withColumn("_x", ts.real(value))
    return series.with_series(rows, {name: ("halflifemean", ("_x",), (window, halflife, least))}).drop("_x")


def log_return(ret: Column) -> Column:
    """ln(1 + return), a loss of all held at 99.9 %; null without a return."""
    return F.when(ts.real(ret).isNotNull(), F.log1p(F.greatest(ret, F.lit(-0.999))))


def normalized(panel: DataFrame, *names: str) -> DataFrame:
    """Each column clipped at the date's outer hundredths, then standardised and held within three deviations."""
    panel = panel.withColumns({n: cs.winsorize(F.col(n)) for n in names})
    return panel.withColumns({n: cs.cs_zscore(F.col(n)) for n in names})


def with_styles(panel: DataFrame, cap: str = "cap", ret: str = "ret", market: str = "market", turnover: str = "turnover") -> DataFrame:
    """size, nonlin_size, beta, res_vol, momentum and liquidity of each row, standardised by date.

    panel: code, date and the named columns, a row for each date of a code. Size is the log of the capitalisation; its
    nonlinear part is the square of the standardised size, freed of it (30 codes at least). Momentum is the half-life mean of log returns that ends MOMENTUM_SKIP rows ago.
    Liquidity is the mean of two standardised logs, of the mean turnover over a quarter and over a year; null where one of them is.
    """
    late = F.lag(log_return(F.col(ret)), MOMENTUM_SKIP).over(ts.whole())
    rows = panel.withColumns({"_size": F.when(F.col(cap) > 0, F.ln(cap)), "_r": ts.real(F.col(ret)), "_m": ts.real(F.col(market)), "_traded": ts.real(F.col(turnover)), "_late": ts.real(late)})
    # All that reads one code's rows is made in one pass over them, all that reads one date's in another.
    of_code = series.with_series(rows, {
        **_regression("_r", "_m", BETA_HALFLIFE, BETA_WINDOW, "res_vol"), "momentum": ("halflifemean", ("_late",), (MOMENTUM_WINDOW, MOMENTUM_HALFLIFE, 0.5)),
        **{f"_t{w}": ("mean", ("_traded",), (w, max(2, w // 2))) for w in LIQUIDITY_WINDOWS},
    }).drop("_r", "_m", "_traded", "_late")
    kept, inputs = panel.columns, ["_size", "beta", "res_vol", "momentum", *[f"_t{w}" for w in LIQUIDITY_WINDOWS]]
    schema = StructType([*panel.schema.fields, *[StructField(n, DoubleType()) for n in STYLES]])

    def standardise(day: pa.Table) -> pa.Table:
        size, beta, res_vol, momentum, *legs = (pc.fill_null(day.column(n), np.nan).to_numpy() for n in inputs)
        standard = lambda x: series.zscored(series.winsorized(x, 0.01), 3.0)
        with np.errstate(all="ignore"):
            liquidity = sum(standard(np.log(np.where(x > 0, x, np.nan))) for x in legs) / len(legs)
            out = {n: standard(x) for n, x in (("size", size), ("beta", beta), ("res_vol", res_vol), ("momentum", momentum), ("liquidity", liquidity))}
            out["nonlin_size"] = standard(_free_of(out["size"] ** 2, out["size"]))
        return pa.table([*(day.column(n) for n in kept), *(pa.array(out[n], from_pandas=True) for n in STYLES)], names=[*kept, *STYLES])

    return of_code.groupBy(ts.ORDER).applyInArrow(standardise, schema)


def _free_of(y: np.ndarray, x: np.ndarray, least: int = 30) -> np.ndarray:
    """Residual of y on x and a constant; null for fewer than `least` values, or where x doesn't vary."""
    known = np.isfinite(x) & np.isfinite(y)
    if known.sum() < least or x[known].min() == x[known].max():
        return np.full(len(x), np.nan)
    off = x[known] - x[known].mean()
    slope = off @ y[known] / (off @ off)
    return y - (y[known].mean() + slope * (x - x[known].mean()))
