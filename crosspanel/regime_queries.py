"""Queries of exposure by market regime, of weights from covariances and of fractional differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import timeseries as ts
from .operators import fractional, optimize, regime
from .queries import CODE, c, query, rounded, scored
from .sources.panel import weekly_panel
from .universe_queries import CAP, sized

REGIME_SQL = CAP + f""", ix AS (SELECT date, sum(amount) / sum(volume) AS px FROM P GROUP BY date), i1 AS (SELECT date, px, px / lag(px) OVER (ORDER BY date) - 1 AS r FROM ix),
i2 AS (SELECT date, CASE WHEN count(px) OVER t >= 30 THEN px / avg(px) OVER t - 1 END AS trend, CASE WHEN count(r) OVER v >= 10 THEN stddev_samp(r) OVER v END AS vol FROM i1 WINDOW t AS (ORDER BY date ROWS 59 PRECEDING), v AS (ORDER BY date ROWS 19 PRECEDING)),
i3 AS (SELECT date, trend, vol / CASE WHEN count(vol) OVER m >= 60 THEN quantile_cont(vol, 0.5) OVER m END AS calm FROM i2 WINDOW m AS (ORDER BY date ROWS 251 PRECEDING)),
bm AS (SELECT date, close, CASE WHEN count(close) OVER w >= 10 THEN avg(close) OVER w END AS m FROM P WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)), bd AS (SELECT date, sum(CASE WHEN coalesce(close > m, false) THEN 1.0 ELSE 0.0 END) / nullif(count(close), 0) AS breadth FROM bm GROUP BY date),
sr AS (SELECT code, date, cap, close / lag(close) {CODE} - 1 AS ret FROM C), sl AS (SELECT code, date, cap, CASE WHEN ret IS NOT NULL THEN ln(1 + greatest(ret, -0.999999)) END AS l FROM sr), sw AS (SELECT date, cap, CASE WHEN count(l) OVER w >= 10 THEN exp(sum(l) OVER w) - 1 END AS w FROM sl WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)),
sq AS (SELECT date, w, cap, quantile_cont(cap, 0.3) OVER d AS lo, quantile_cont(cap, 0.7) OVER d AS hi, count(cap) OVER d AS n FROM sw WINDOW d AS (PARTITION BY date)), sz AS (SELECT date, CASE WHEN max(n) >= 5 THEN avg(w) FILTER (cap <= lo) - avg(w) FILTER (cap >= hi) END AS size_style FROM sq GROUP BY date),
g0 AS (SELECT i3.date, lag(trend) OVER o AS mkt_trend, lag(calm) OVER o AS mkt_vol, lag(breadth) OVER o AS mkt_breadth, lag(size_style) OVER o AS size_style FROM i3 LEFT JOIN bd ON bd.date = i3.date LEFT JOIN sz ON sz.date = i3.date WINDOW o AS (ORDER BY i3.date)),
g1 AS (SELECT *, CASE WHEN coalesce(mkt_trend > 0, false) THEN 1.0::DOUBLE ELSE 0.0 END AS trend_on, CASE WHEN coalesce(mkt_vol < 1, false) THEN 1.0::DOUBLE ELSE 0.0 END AS vol_ok, CASE WHEN mkt_breadth IS NOT NULL THEN CASE WHEN mkt_breadth > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END END AS breadth_on FROM g0),
RG AS (SELECT *, trend_on + vol_ok + coalesce(breadth_on, 0) AS score, 0.3 + 0.7 * (trend_on + vol_ok + coalesce(breadth_on, 0)) / CASE WHEN breadth_on IS NULL THEN 2 ELSE 3 END AS target_exposure FROM g1)"""


def regimes(spark, folder):
    panel = sized(spark, folder)
    index = panel.groupBy("date").agg((F.sum("amount") / F.sum("volume")).alias("px"))
    returns = panel.withColumn("ret", c("close") / ts.delay(c("close"), 1) - 1)
    return regime.position_regime(index, panel, regime.size_spread(returns, least=5))


@query(REGIME_SQL + " SELECT date, round(mkt_trend, 6) AS mkt_trend, round(mkt_vol, 6) AS mkt_vol, round(mkt_breadth, 6) AS mkt_breadth, round(size_style, 6) AS size_style, trend_on, vol_ok, breadth_on, score, round(target_exposure, 6) AS target_exposure FROM RG")
def position_regime(spark, folder):
    """Exposure by trend, calm and breadth of the date before."""
    return rounded(regimes(spark, folder))


@query(REGIME_SQL + """, sd AS (SELECT DISTINCT CAST(last_day(date) AS DATE) AS date FROM P UNION SELECT DATE '1990-01-01'), lt AS (SELECT sd.date, arg_max(target_exposure, RG.date) AS e FROM sd JOIN RG ON RG.date <= sd.date GROUP BY 1) SELECT sd.date, round(coalesce(e, 1), 6) AS exposure FROM sd LEFT JOIN lt ON lt.date = sd.date""")
def exposure_as_of(spark, folder):
    """Exposure on each month's last day, most of which are no dates of the panel, and on a day before all of them."""
    days = weekly_panel(spark, folder).select(F.last_day("date").alias("date")).distinct()
    first = days.sparkSession.createDataFrame([("1990-01-01",)], "date string").select(F.to_date("date").alias("date"))
    return rounded(regime.exposures(regimes(spark, folder), days.union(first)))


@query()
def optimized_weights(spark, folder):
    """Weights of each month's ten best scores by mean and variance, equal risk, inverse deviation, score, rank and equally, none above a quarter."""
    panel = scored(spark, folder)
    last = panel.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "code"))
    best = panel.join(F.broadcast(last), "date").where("score is not null").withColumn("place", place).where("place <= 10").select(c("date").alias("period"), "code", "score")
    return rounded(optimize.period_weights(best, panel.select("code", "date", "ret"), list(optimize.METHODS), 60, 1.0, 0.25))


_WIDTH = fractional.weights(0.4, 1e-3)


@query(f", lc AS (SELECT code, date, row_number() {CODE} AS t, ln(last_value(close IGNORE NULLS) {CODE}) AS x FROM P), wk AS (SELECT k, w FROM (SELECT unnest(generate_series(0, {len(_WIDTH) - 1})) AS k, unnest([{', '.join(f'{w!r}::DOUBLE' for w in _WIDTH.tolist())}]) AS w))," + """
fs AS (SELECT a.code, a.date, count(b.x) AS n, sum(b.x * w) AS v FROM lc a JOIN lc b ON a.code = b.code AND b.t <= a.t JOIN wk ON k = a.t - b.t GROUP BY 1, 2) SELECT lc.code, lc.date, round(CASE WHEN n = (SELECT count(*) FROM wk) THEN v END, 6) AS x FROM lc JOIN fs ON fs.code = lc.code AND fs.date = lc.date""")
def fractional_difference_full(spark, folder):
    """Order 0.4 of the log of the last close, with all weights down to a thousandth."""
    panel = weekly_panel(spark, folder)
    return rounded(fractional.fractional_difference(panel.withColumn("last", ts.carried(c("close"))), F.ln("last"), 0.4, "x", 1e-3))


@query()
def stationary_order(spark, folder):
    """p values of the unit-root test by order, over the twenty fullest codes, and the least order that passes."""
    panel = weekly_panel(spark, folder).withColumn("last", ts.carried(c("close")))
    table = fractional.stationarity(panel, F.ln("last"), [k / 10 for k in range(11)], 1e-2)
    return rounded(table.crossJoin(F.broadcast(fractional.optimal_order(table).withColumnRenamed("d", "optimal"))))
