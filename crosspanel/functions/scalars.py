"""Row-wise functions: codes, report dates, costs, text of event tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stock_code(code: Column) -> Column:
    """Digits before the exchange suffix, padded to six; fewer than five digits stay as they are."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(code.cast("string")), r"\..*$", ""), r"\D", "")
    return F.when(F.length(digits) >= 5, F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))).otherwise(code)


def is_b_share(code: Column) -> Column:
    return code.rlike("^(200|900)")


def is_excluded(code: Column) -> Column:
    return code.rlike("^(8|200|900)")


def disclosure_days(report: Column) -> Column:
    """Days until a report must be out: 30, 60, 30 and 90 for the four quarters, by the quarter's last month."""
    quarter = F.quarter(report)
    return F.when(quarter == 1, 30).when(quarter == 2, 60).when(quarter == 3, 30).otherwise(90)


def available_date(report: Column) -> Column:
    return F.date_add(report, disclosure_days(report))


def institution_count(text: Column, side: str) -> Column:
    return F.regexp_extract(text, r"(\d+)\D{0,3}" + side, 1).try_cast("int")


def log_magnitude(change: Column, bound: float = 1000.0) -> Column:
    clipped = F.greatest(F.least(change, F.lit(bound)), F.lit(-bound))
    return F.when(change.isNotNull(), F.signum(clipped) * F.log1p(F.abs(clipped)))


def trade_cost(turnover: Column, commission: float = 0.0003, stamp: float = 0.001, spread: float = 0.001) -> Column:
    """Half of the turnover is bought and half sold; stamp duty on what is sold, half the spread on both."""
    half = turnover / 2
    return half * (commission + spread / 2) + half * (commission + stamp + spread / 2)


#: Share of commission and slippage on each side, of stamp duty on what is sold, and the spread in hundredths of a percent.
COMMISSION, SLIPPAGE, STAMP, SPREAD_BPS = 0.0001, 0.0, 0.0005, 10.0


def rebalance_cost(turnover: Column, commission: float = COMMISSION, slippage: float = SLIPPAGE, stamp: float = STAMP, spread_bps: float = SPREAD_BPS, flat_bps: float = 0.0) -> Column:
    """Cost of a change of holdings as a share of their value: half of it bought and half sold, half the spread on all of it; flat_bps where all these rates are zero. Nothing for no turnover."""
    half = turnover / 2
    total = half * (commission + slippage) + half * (commission + stamp + slippage) + turnover * (spread_bps / 10000 / 2)
    if 2 * (commission + slippage) + stamp + spread_bps <= 0:
        total = turnover * (flat_bps / 10000)
    return F.when(turnover > 0, total).when(turnover.isNotNull(), 0.0)


def round_trip(commission: float = COMMISSION, slippage: float = SLIPPAGE, stamp: float = STAMP) -> float:
    """Cost of buying and selling once."""
    return 2 * (commission + slippage) + stamp


def ic_after_cost(mean: Column, turnover: Column, cost: float | None = None) -> Column:
    """The mean coefficient less the turnover's cost, whatever its sign; null if either is."""
    return mean - turnover * (round_trip() if cost is None else cost)


def reason_bucket(reason: Column) -> Column:
    """turnover, down, up or other, by the first of these that a listing's reason speaks of."""
    said = F.coalesce(reason, F.lit(""))
    # The words for turnover, fall and rise.
    return F.when(said.contains("换手"), "turnover").when(said.contains("跌"), "down").when(said.contains("涨"), "up").otherwise("other")


def as_share(df, name: str):
    """The table with a column that holds percentages divided by 100: it does if the absolute median of all its values is above 1.5."""
    middle = df.agg(F.percentile(name, F.lit(0.5)).alias("_m"))  # one row
    return df.crossJoin(F.broadcast(middle)).withColumn(name, F.when(F.abs("_m") > 1.5, F.col(name) / 100).otherwise(F.col(name))).drop("_m")


def periods_per_year(freq: str | None) -> int:
    """Of a rebalance frequency: names of weeks, months and quarters, or a number of trading days (5D); 12 for any other."""
    known = {**dict.fromkeys(("W", "W-MON", "W-TUE", "W-WED", "W-THU", "W-FRI"), 52), "2W-FRI": 26, "ME": 12, "MS": 12, "QE": 4, "20D": 12}
    key = str(freq or "").strip().upper()
    if key in known:
        return known[key]
    days = key[:-1]
    return max(1, round(252 / int(days))) if key.endswith("D") and days.isdigit() and int(days) > 0 else 12


def periods_of_months(months: int, freq: str) -> int:
    """Calendar months in steps of a rebalance frequency; 0 stays 0."""
    key = freq.upper()
    a_year = 26 if "2W" in key else 52 if key.startswith("W") or key.endswith("D") else 12
    return 0 if months == 0 else months if a_year == 12 else max(1, round(months * a_year / 12))


def frequency_of_horizon(days: int) -> str:
    """The rebalance frequency that suits a hold period in trading days."""
    return "3D" if days <= 3 else "W-FRI" if days <= 7 else "2W-FRI" if days <= 15 else "ME"
