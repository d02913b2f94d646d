"""Queries of named factors and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import timeseries as ts
from .operators import clean
from .plans import named, passes
from .queries import CODE, c, frame_sql, query, rounded
from .sources.panel import with_industry
from .universe_queries import sized

NAMED_SQL = f""", L0 AS (SELECT *, close / lag(close) {CODE} - 1 AS ch FROM P), L1 AS (SELECT *, coalesce(close = high AND ch >= 0.095::DOUBLE * 0.98::DOUBLE, false) AS lu, coalesce(close = low AND ch <= -(0.095::DOUBLE * 0.98::DOUBLE), false) AS ld FROM L0),
L2 AS (SELECT *, lu AND coalesce(open = close, false) AS luo, ld AND coalesce(open = close, false) AS ldo FROM L1),
G0 AS (SELECT *, CASE WHEN NOT lu AND NOT ld THEN ch END AS r, lag(close) {CODE} AS pc, coalesce(lag(lu) {CODE}, false) AND NOT lu AS broke, close * (CAST(code AS INTEGER) % 50 + 1) * 1000000.0::DOUBLE AS cap FROM L2),
G AS (SELECT G0.*, industry FROM G0 LEFT JOIN I ON I.code = G0.code)"""


def _guard(expr: str, x: str, w: int, least: int) -> str:
    return f"CASE WHEN count({x}) {frame_sql(w)} >= {least} THEN {expr} {frame_sql(w)} END"


def _momentum(w: int) -> str:
    return f"(exp({_guard('sum(CASE WHEN r > -1 THEN ln(1 + r) END)', 'r', w, max(1, w // 2))}) - 1)"


def factor_panel(spark, folder):
    panel = clean.clean_return(sized(spark, folder)).withColumn("close_before", ts.delay(c("close"), 1))
    return with_industry(spark, folder, panel)


def _picked(parts: dict[str, str], digits: int = 6) -> str:
    return " SELECT code, date, " + ", ".join(f"round({e}, {digits}) AS {n}" for n, e in parts.items()) + " FROM G"


_PV = {f"momentum_{w}": _momentum(w) for w in (3, 10, 20, 60, 120)} | {f"reversal_{w}": "-" + _momentum(w) for w in (3, 5, 10, 20)} | {
    "momentum_skip": f"(1 + {_momentum(240)}) / (1 + {_momentum(20)}) - 1",
    "volatility_20": "-" + _guard("stddev_samp(r)", "r", 20, 10), "volatility_60": "-" + _guard("stddev_samp(r)", "r", 60, 30), "turnover_20": "-" + _guard("avg(volume)", "volume", 20, 20),
    "illiquidity_20": f"1e6 * {_guard('avg(abs(r) / nullif(amount, 0))', 'abs(r) / nullif(amount, 0)', 20, 10)}",
    "amplitude_20": "-" + _guard("avg(CASE WHEN NOT (luo OR ldo) THEN (high - low) / nullif(close, 0) END)", "CASE WHEN NOT (luo OR ldo) THEN (high - low) / nullif(close, 0) END", 20, 10),
    "to_high_52": f"close / {_guard('max(close)', 'close', 52, 52)}",
}


@query(NAMED_SQL + _picked(_PV))
def factors_price_volume(spark, folder):
    made = named.price_volume()
    made["illiquidity_20"] = made["illiquidity_20"] * 1e6
    return rounded(passes.library(_as_numbers(factor_panel(spark, folder)), made))


def _as_numbers(panel):
    """Flags, which are never null, as 1 and 0: a pass over a code's rows reads numbers."""
    return panel.withColumns({n: c(n).cast("double") for n, kind in panel.dtypes if kind == "boolean"})


def _ratio(a: str, b: str) -> str:
    return f"100 * ({a}) / nullif({b}, 0)"


_BELOW = "CASE WHEN greatest(pc - low, 0) <> 0 AND pc IS NOT NULL AND low IS NOT NULL THEN greatest(pc - low, 0) END"
_ABOVE = "CASE WHEN pc IS NOT NULL AND high IS NOT NULL THEN greatest(high - pc, 0) END"
_TECH = {f"bias_{w}": f"(close - {_guard('avg(close)', 'close', w, w // 2)}) / nullif({_guard('avg(close)', 'close', w, w // 2)}, 0)" for w in (5, 20)} | {
    "psy_12": f"100 * CASE WHEN count(*) {frame_sql(12)} >= 6 THEN avg(CASE WHEN coalesce(r > 0, false) THEN 1.0 ELSE 0 END) {frame_sql(12)} END",
    "ar_26": _ratio(_guard("sum(high - open)", "high - open", 26, 13), _guard("sum(nullif(open - low, 0))", "nullif(open - low, 0)", 26, 13)),
    "br_26": _ratio(_guard(f"sum({_ABOVE})", _ABOVE, 26, 13), _guard(f"sum({_BELOW})", _BELOW, 26, 13)),
    "turnover_acceleration": f"({_guard('avg(volume)', 'volume', 5, 2)}) / nullif({_guard('avg(volume)', 'volume', 20, 10)}, 0)",
}


@query(NAMED_SQL + _picked(_TECH, 7))
def factors_technical(spark, folder):
    return rounded(passes.library(_as_numbers(factor_panel(spark, folder)), named.technical()), 7)


def _count(x: str) -> str:
    return f"sum(CASE WHEN {x} THEN 1.0 ELSE 0.0 END) {frame_sql(20)}"


@query(NAMED_SQL + _picked({"limit_state": "CASE WHEN lu THEN 3.0 WHEN ld THEN 1.0 ELSE 2.0 END", "limit_up_20": _count("lu AND NOT luo"), "limit_down_20": "-" + _count("ld"), "limit_net_20": f"{_count('lu')} - {_count('ld')}", "after_break_5": f"CASE WHEN lag(broke, 5) {CODE} THEN -(close / lag(close, 5) {CODE} - 1) END"}))
def factors_limit(spark, folder):
    return rounded(factor_panel(spark, folder).select("code", "date", *[x.alias(n) for n, x in named.limits().items()]))


@query(NAMED_SQL + _picked({"log_size": "-ln(cap)", "size_share": "1 - CASE WHEN cap IS NOT NULL THEN (rank() OVER (PARTITION BY date, cap IS NULL ORDER BY cap) + (count(*) OVER (PARTITION BY date, cap) - 1) / 2.0) / count(cap) OVER (PARTITION BY date) END", "root_weight": "sqrt(cap)"}, 4))
def factors_size(spark, folder):
    return rounded(factor_panel(spark, folder).select("code", "date", *[x.alias(n) for n, x in named.sizes().items()]), 4)


@query(NAMED_SQL + f", mv AS (SELECT code, date, industry, {_momentum(20)} AS m, {_guard('avg(volume)', 'volume', 20, 10)} AS v FROM G), n AS (SELECT *, count(m) OVER w AS nm, avg(m) OVER w AS am, sum(m) OVER w AS sm, count(v) OVER w AS nv, avg(v) OVER w AS av FROM mv WINDOW w AS (PARTITION BY date, industry)) SELECT code, date, round(CASE WHEN nm >= 2 THEN m - am ELSE m END, 6) AS relative_strength, round(CASE WHEN nv >= 2 THEN v - av ELSE v END, 6) AS neutral_turnover, round(CASE WHEN nm >= 2 THEN (sm - m) / (nm - 1) END, 6) AS industry_momentum FROM n")
def factors_industry(spark, folder):
    return rounded(named.with_industry_means(factor_panel(spark, folder)).select("code", "date", "relative_strength", "neutral_turnover", "industry_momentum"))


@query(NAMED_SQL + ", k AS (SELECT date, r, CASE WHEN cap IS NOT NULL THEN (rank() OVER (PARTITION BY date, cap IS NULL ORDER BY cap) + (count(*) OVER (PARTITION BY date, cap) - 1) / 2.0) / count(cap) OVER (PARTITION BY date) END AS q FROM G) SELECT date, round(avg(r) FILTER (q <= 0.3) - avg(r) FILTER (q > 1 - 0.3::DOUBLE), 6) AS spread FROM k GROUP BY date")
def size_style_spread(spark, folder):
    return rounded(named.style_spread(factor_panel(spark, folder), "ret", "cap"))


@query(NAMED_SQL + f", f AS (SELECT code, date, {_momentum(20)} AS a, -{_guard('stddev_samp(r)', 'r', 20, 10)} AS b FROM G), q AS (SELECT *, quantile_cont(a, 0.01) OVER d AS al, quantile_cont(a, 0.99) OVER d AS ah, quantile_cont(b, 0.01) OVER d AS bl, quantile_cont(b, 0.99) OVER d AS bh FROM f WINDOW d AS (PARTITION BY date)), w AS (SELECT code, date, CASE WHEN a IS NOT NULL THEN greatest(least(a, ah), al) END AS a, CASE WHEN b IS NOT NULL THEN greatest(least(b, bh), bl) END AS b FROM q), z AS (SELECT code, date, (a - avg(a) OVER (PARTITION BY date)) / CASE WHEN stddev_pop(a) OVER (PARTITION BY date) > 1e-12 THEN stddev_pop(a) OVER (PARTITION BY date) END AS a, (b - avg(b) OVER (PARTITION BY date)) / CASE WHEN stddev_pop(b) OVER (PARTITION BY date) > 1e-12 THEN stddev_pop(b) OVER (PARTITION BY date) END AS b FROM w) SELECT code, date, round(CASE WHEN a IS NOT NULL THEN greatest(least(a, 3), -3) END, 5) AS momentum_20, round(CASE WHEN b IS NOT NULL THEN greatest(least(b, 3), -3) END, 5) AS volatility_20 FROM z")
def named_normalized(spark, folder):
    raw = named.price_volume()
    panel = passes.library(_as_numbers(factor_panel(spark, folder)), {n: raw[n] for n in ("momentum_20", "volatility_20")})
    return rounded(named.normalized(panel, ["momentum_20", "volatility_20"]), 5)
