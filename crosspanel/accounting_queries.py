"""Queries of accounting figures as of their disclosure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import crosssection as cs
from .functions import scalars
from .operators import accounting, asof
from .queries import c, query, rounded
from .sources.panel import table
from .universe_queries import CAP, sized

# Quarterly reports of suppliers: the year's sales so far and units; every fifth supplier restates each report 50 days later, two hundredths higher.
CUM_SQL = """, qs AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, year(l_shipdate) AS y, quarter(l_shipdate) AS k, round(sum(l_extendedprice), 2) AS sales, sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2, 3),
cu AS (SELECT code, y, k, CAST(make_date(y, k * 3, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS report_date, sum(sales) OVER w AS sales, sum(units) OVER w AS units FROM qs WINDOW w AS (PARTITION BY code, y ORDER BY k)),
rp0 AS (SELECT *, CAST(report_date + to_days(CAST(CASE k WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 30 ELSE 90 END AS INTEGER)) AS DATE) AS available FROM cu),
RP AS (SELECT code, report_date, available, CAST(y AS INTEGER) * 4 + k - 1 AS q, sales, CAST(units AS DOUBLE) AS units FROM rp0 UNION ALL SELECT code, report_date, available + 50, CAST(y AS INTEGER) * 4 + k - 1, sales * 1.02::DOUBLE, CAST(units AS DOUBLE) FROM rp0 WHERE CAST(code AS INTEGER) % 5 = 0)"""
_LATEST = "(SELECT arg_max({v}, r.available) FROM RP r WHERE r.code = e.code AND r.available <= e.available AND r.q = {q})"
FIGURES_SQL = CUM_SQL + """, ev AS (SELECT DISTINCT code, available FROM RP), e1 AS (SELECT ev.code, ev.available, max(r.q) AS q FROM ev JOIN RP r ON r.code = ev.code AND r.available <= ev.available GROUP BY 1, 2),
vs AS (SELECT e.code, e.available, e.q, r.q AS p, arg_max(sales, r.available) AS sales, arg_max(units, r.available) AS units, max(r.available) AS since FROM e1 e JOIN RP r ON r.code = e.code AND r.available <= e.available AND r.q <= e.q AND r.q >= e.q - 7 GROUP BY 1, 2, 3, 4),
pv AS (SELECT code, available, q, """ + ", ".join(f"max({v}) FILTER (p = {p}) AS {v}_{n}" for v in ("sales", "units") for n, p in (("now", "q"), ("before", "q - 1"), ("ago", "q - 4"), ("annual", "q // 4 * 4 - 1"))) + """,
 bool_or(since = available AND (p = q OR p = q - 4 OR p = q // 4 * 4 - 1 OR (p = q - 1 AND q % 4 <> 0))) AS changed FROM vs GROUP BY 1, 2, 3),
FG AS (SELECT code, q AS quarter, available, """ + ", ".join(f"CASE WHEN q % 4 = 3 THEN {v}_now ELSE {v}_now + {v}_annual - {v}_ago END AS {v}_ttm, CASE WHEN q % 4 = 0 THEN {v}_now ELSE {v}_now - {v}_before END AS {v}_quarter, ({v}_now - {v}_ago) / CASE WHEN abs({v}_ago) > 1e-12 THEN abs({v}_ago) END AS {v}_growth" for v in ("sales", "units")) + " FROM pv WHERE changed)"


def quarterly_reports(spark, folder):
    lines = table(spark, folder, "lineitem")
    sums = lines.groupBy(F.lpad(c("l_suppkey").cast("string"), 6, "0").alias("code"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("sales"), F.sum("l_quantity").cast("double").alias("units"))
    over = Window.partitionBy("code", "y").orderBy("k")
    year = sums.select("code", F.last_day(F.make_date("y", c("k") * 3, F.lit(1))).alias("report_date"), F.sum("sales").over(over).alias("sales"), F.sum("units").over(over).alias("units"))
    first = year.withColumn("available", scalars.available_date(c("report_date")))
    again = first.where(c("code").cast("int") % 5 == 0).select("code", "report_date", (c("sales") * F.lit(1.02)).alias("sales"), "units", F.date_add("available", 50).alias("available"))
    return first.unionByName(again)


@query(FIGURES_SQL + " SELECT code, quarter, available, " + ", ".join(f"round({v}_{n}, 4) AS {v}_{n}" for v in ("sales", "units") for n in ("ttm", "quarter", "growth")) + " FROM FG")
def accounting_figures(spark, folder):
    """Trailing year, single quarter and growth of sales and units at each disclosure that changes them."""
    return rounded(accounting.figures(quarterly_reports(spark, folder), ["sales", "units"]), 4)


_FACTORS_SQL = CAP + FIGURES_SQL + """, f1 AS (SELECT code, available, sales_ttm FROM FG WHERE sales_ttm IS NOT NULL), f2 AS (SELECT code, available, sales_growth FROM FG WHERE sales_growth IS NOT NULL), f3 AS (SELECT code, available, units_growth FROM FG WHERE units_growth IS NOT NULL),
ax AS (SELECT C.code, C.date, sales_ttm / CASE WHEN cap > 0 THEN cap END AS sales_yield, sales_growth, units_growth FROM C ASOF LEFT JOIN f1 ON C.code = f1.code AND C.date >= f1.available ASOF LEFT JOIN f2 ON C.code = f2.code AND C.date >= f2.available ASOF LEFT JOIN f3 ON C.code = f3.code AND C.date >= f3.available)"""


_N = ("sales_yield", "sales_growth", "units_growth")
_FACTORS_SQL += ", a1 AS (SELECT code, date, " + ", ".join(f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, quantile_cont({x}, 0.99) OVER d), quantile_cont({x}, 0.01) OVER d) END AS {x}" for x in _N) + " FROM ax WINDOW d AS (PARTITION BY date)), a2 AS (SELECT code, date, " + ", ".join(f"CASE WHEN {x} IS NOT NULL AND stddev_pop({x}) OVER d > 1e-12 THEN greatest(least(({x} - avg({x}) OVER d) / CASE WHEN stddev_pop({x}) OVER d > 1e-12 THEN stddev_pop({x}) OVER d END, 3), -3) END AS {x}" for x in _N) + " FROM a1 WINDOW d AS (PARTITION BY date))"


@query(_FACTORS_SQL + " SELECT code, date, " + ", ".join(f"round(CASE WHEN {x} IS NOT NULL THEN {x} END, 5) AS {x}" for x in _N) + " FROM a2")
def accounting_factors(spark, folder):
    """Sales of the trailing year over capitalisation, and growth of sales and units, as of their disclosure and standardised by date."""
    figures = accounting.figures(quarterly_reports(spark, folder), ["sales", "units"])
    caps = sized(spark, folder).select("code", "date", "cap")
    joined = asof.as_of(caps, figures, ["sales_ttm", "sales_growth", "units_growth"]).join(caps, ["code", "date"])
    panel = joined.withColumn("sales_yield", c("sales_ttm") / F.when(c("cap") > 0, c("cap")))
    panel = panel.select("code", "date", *(cs.winsorize(c(x)).alias(x) for x in _N))
    return rounded(panel.select("code", "date", *(cs.cs_zscore(c(x)).alias(x) for x in _N)), 5)
