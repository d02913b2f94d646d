"""Queries of hold periods and of coefficients over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import timeseries as ts
from .model_queries import ROWS_SQL, factor_ics, factor_rows, stored_scores
from .operators import backtest, ic, signals
from .queries import CODE, SCORE_SQL, c, query, rounded, scored
from .sources.store import written
from .sources.panel import weekly_panel

# Hold periods: signals on each month's last date, the ten best scores, orders filled on the next date.
HOLD_SQL = SCORE_SQL + f""", sg AS (SELECT max(date) AS signal FROM P GROUP BY date_trunc('month', date)), cal AS (SELECT DISTINCT date FROM P),
pr0 AS (SELECT date, max(signal) AS period FROM cal JOIN sg ON signal < date GROUP BY date), pr AS (SELECT *, min(date) OVER (PARTITION BY period) AS executed FROM pr0),
pk AS (SELECT S.date AS period, code, row_number() OVER (PARTITION BY S.date ORDER BY score DESC, code) AS r FROM S JOIN sg ON S.date = signal WHERE score IS NOT NULL AND volume > 0),
px AS (SELECT code, date, open, close, volume, lag(close) {CODE} AS cb, coalesce(close < 0.9::DOUBLE * lag(close) {CODE}, false) AS no_sale FROM P),
hd AS (SELECT pk.period, pk.code, coalesce(px.no_sale, false) AS stuck FROM pk JOIN (SELECT DISTINCT period, executed FROM pr) e ON e.period = pk.period LEFT JOIN px ON px.code = pk.code AND px.date = e.executed WHERE r <= 10),
h0 AS (SELECT hd.period, hd.code, stuck, px.date, executed, open, close, cb, no_sale, NOT coalesce(close > 0 AND volume > 0, false) AS suspended, px.date = executed AS fd, last_value(close IGNORE NULLS) OVER (PARTITION BY hd.period, hd.code ORDER BY px.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc FROM px JOIN pr ON pr.date = px.date JOIN hd ON hd.period = pr.period AND hd.code = px.code),
h1 AS (SELECT *, min(CASE WHEN stuck AND NOT fd AND NOT suspended AND NOT no_sale THEN date END) OVER (PARTITION BY period, code) AS exit_date, CASE WHEN fd THEN open ELSE lc END AS base FROM h0),
h2 AS (SELECT *, CASE WHEN coalesce(date > exit_date, false) THEN 0 ELSE coalesce(CASE WHEN base > 0 AND close IS NOT NULL AND NOT suspended THEN close / base - 1 END, 0) END AS ret FROM h1),
HP AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY period, code ORDER BY date)) AS nav FROM h2),
HV AS (SELECT period, date, avg(nav) * (1 - 0.001::DOUBLE) AS nav, count(*) AS held FROM HP GROUP BY period, date)"""


def paths(spark, folder):
    panel = scored(spark, folder)
    last = panel.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")
    periods = backtest.hold_periods(panel.select("date").distinct(), last)
    rank = F.row_number().over(ts.Window.partitionBy("date").orderBy(F.desc("score"), "code"))
    chosen = panel.join(F.broadcast(last), "date").where("score is not null and volume > 0").withColumn("r", rank).where("r <= 10").select(c("date").alias("period"), "code")
    prices = panel.withColumn("no_sale", F.coalesce(c("close") < F.lit(0.9) * ts.delay(c("close"), 1), F.lit(False))).select("code", "date", "open", "close", "volume", "no_sale")
    executions = periods.select("period", "executed").distinct()
    at = prices.select("code", c("date").alias("executed"), c("no_sale").alias("stuck"))
    holdings = chosen.join(F.broadcast(executions), "period").join(at, ["code", "executed"], "left").select("period", "code", F.coalesce("stuck", F.lit(False)).alias("stuck"))
    return backtest.daily_returns(prices, holdings, periods)


@query(HOLD_SQL + " SELECT period, code, date, exit_date, suspended, round(ret, 6) AS ret, round(nav, 6) AS nav FROM HP")
def stock_nav_paths(spark, folder):
    return rounded(paths(spark, folder).drop("executed"))


@query(HOLD_SQL + " SELECT period, date, round(nav, 6) AS nav, held FROM HV")
def portfolio_nav(spark, folder):
    return rounded(backtest.portfolio_values(paths(spark, folder), cost=0.001))


@query(HOLD_SQL + ", wt AS (SELECT period, date, sum(w * nav) / sum(w) * (1 - 0.001::DOUBLE) AS nav, count(*) AS held FROM (SELECT *, (CAST(code AS INTEGER) % 5)::DOUBLE + 1 AS w FROM HP) GROUP BY period, date) SELECT period, date, round(nav, 6) AS nav, held FROM wt")
def portfolio_nav_weighted(spark, folder):
    held = paths(spark, folder)
    weights = held.select("period", "code").distinct().withColumn("weight", (c("code").cast("int") % 5 + 1).cast("double"))
    return rounded(backtest.portfolio_values(held, weights, cost=0.001))


@query(HOLD_SQL + ", l AS (SELECT period, arg_max(nav, date) - 1 AS ret, max(held) AS held FROM HV GROUP BY period), x AS (SELECT period, count(DISTINCT CASE WHEN exit_date IS NOT NULL THEN code END) AS left_early FROM HP GROUP BY period) SELECT l.period, round(ret, 6) AS ret, held, left_early, round(ret * 0.8, 6) AS exposed FROM l JOIN x ON x.period = l.period")
def period_simulate(spark, folder):
    held = paths(spark, folder)
    out = backtest.period_results(backtest.portfolio_values(held, cost=0.001), held)
    return rounded(out.withColumn("exposed", backtest.exposed(c("ret"), F.lit(0.8))))


@query(HOLD_SQL + ", l AS (SELECT period, arg_max(nav, date) AS v FROM HV GROUP BY period) SELECT period, round(sum(ln(v)) OVER (ORDER BY period), 6) AS log_nav FROM l")
def compounded_nav(spark, folder):
    """The periods' values one after the other; one row for each period."""
    values = backtest.portfolio_values(paths(spark, folder), cost=0.001).groupBy("period").agg(F.max_by("nav", "date").alias("v"))
    over = ts.Window.orderBy("period").rowsBetween(ts.Window.unboundedPreceding, 0)
    return values.select("period", F.round(F.sum(F.ln("v")).over(over), 6).alias("log_nav"))


@query(HOLD_SQL + """, ix0 AS (SELECT date, sum(amount) / sum(volume) AS px FROM P GROUP BY date), ix AS (SELECT date, px, last_value(px IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, lag(px) OVER (ORDER BY date) AS db FROM ix0),
st AS (SELECT period, px, CASE WHEN px IS NOT NULL AND CASE WHEN pr.date = executed THEN bf ELSE db END > 0 THEN px / CASE WHEN pr.date = executed THEN bf ELSE db END ELSE 1 END AS s FROM pr JOIN ix ON ix.date = pr.date) SELECT period, round(CASE WHEN count(px) > 0 THEN product(s) - 1 END, 6) AS ret FROM st GROUP BY period""")
def index_hold_return(spark, folder):
    """The market's return over each hold period, from the close before its execution on."""
    panel = weekly_panel(spark, folder)
    signals_at = panel.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")
    index = panel.groupBy("date").agg((F.sum("amount") / F.sum("volume")).alias("px"))
    return rounded(backtest.index_returns(index, backtest.hold_periods(panel.select("date").distinct(), signals_at)))


IC_SQL = ROWS_SQL + ", K AS (SELECT factor, date, ic, greatest(least(ic, 0.3), -0.3) AS x, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS e, row_number() OVER (PARTITION BY factor ORDER BY date) AS p, count(*) OVER (PARTITION BY factor) AS n FROM FI WHERE ic IS NOT NULL)"
RATIO = "CASE WHEN stddev_pop({x}) {f} > 1e-12 THEN avg({x}) {f} / stddev_pop({x}) {f} WHEN avg({x}) {f} IS NOT NULL THEN 0 END"


def _ratio(f: str = "", x: str = "x") -> str:
    return RATIO.format(x=x, f=f"FILTER ({f})" if f else "")


@query(IC_SQL + " SELECT factor, round(avg(ic) FILTER (ic > 1e-12) / avg(-ic) FILTER (ic < -1e-12), 6) AS payoff FROM K GROUP BY factor")
def ic_payoff(spark, folder):
    return rounded(signals.payoff_ratio(factor_ics(spark, folder).where("ic is not null")))


@query(IC_SQL + ", r AS (SELECT factor, count(*) AS n, avg(ic) AS m, stddev_pop(ic) AS s, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0 END) AS p FROM K WHERE e <= 26 GROUP BY factor) SELECT factor, n, round(CASE WHEN n >= 3 THEN m END, 6) AS recent_ic, round(CASE WHEN n >= 3 AND s > 1e-12 THEN m / s END, 6) AS recent_icir, round(CASE WHEN n >= 3 THEN p END, 6) AS recent_positive FROM r")
def ic_recent(spark, folder):
    return rounded(signals.recent_stats(factor_ics(spark, folder), 26))


RETENTION_SQL = IC_SQL + f", RT0 AS (SELECT factor, max(n) AS n, avg(x) FILTER (e <= 26) AS a, {_ratio('e <= 26')} AS b, {_ratio('e > 26')} AS d FROM K GROUP BY factor), RT AS (SELECT factor, CASE WHEN n >= 29 THEN a END AS ic_recent, CASE WHEN n >= 29 THEN b END AS icir_recent, CASE WHEN n >= 29 THEN d END AS icir_past FROM RT0)"


@query(RETENTION_SQL + " SELECT factor, round(ic_recent, 6) AS ic_recent, round(icir_recent, 6) AS icir_recent, round(icir_past, 6) AS icir_past, round(abs(icir_recent) / CASE WHEN abs(icir_past) > 1e-12 THEN abs(icir_past) END, 4) AS retention, coalesce(abs(icir_recent) / CASE WHEN abs(icir_past) > 1e-12 THEN abs(icir_past) END < 0.5 AND abs(icir_recent) < 0.2 AND abs(ic_recent) < 0.01, false) AS decayed FROM RT")
def ic_decay_label(spark, folder):
    kept = signals.retention(factor_ics(spark, folder), 26)
    out = kept.withColumn("decayed", signals.decayed(c("ic_recent"), c("icir_recent"), c("retention")))
    return out.select("factor", *[F.round(n, 6).alias(n) for n in ("ic_recent", "icir_recent", "icir_past")], F.round("retention", 4).alias("retention"), "decayed")


TREND_SQL = IC_SQL + f", sgm AS (SELECT factor, 3 - CAST(ceil(e / 20) AS INTEGER) AS k, abs({_ratio()}) AS v FROM K WHERE e <= 60 AND n >= 60 GROUP BY 1, 2), TW AS (SELECT factor, max(v) FILTER (k = 0) AS v0, max(v) FILTER (k = 1) AS v1, max(v) FILTER (k = 2) AS v2 FROM sgm GROUP BY factor), TD AS (SELECT f.factor, v0, v1, v2, coalesce(v2 > v0 AND v1 + 0.02 >= v0 AND v2 + 0.02 >= v1, false) AS rising FROM (SELECT DISTINCT factor FROM FI) f LEFT JOIN TW ON TW.factor = f.factor)"


@query(TREND_SQL + " SELECT factor, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2, rising FROM TD")
def ic_segment_trend(spark, folder):
    return rounded(signals.segment_trend(factor_ics(spark, folder), 20))


@query(IC_SQL + ", mm AS (SELECT *, avg(ic) OVER (PARTITION BY factor) AS m FROM K), r AS (SELECT factor, avg(CASE WHEN sign(ic) <> sign(m) AND abs(ic) > 0.015 THEN 1.0 ELSE 0 END) AS fr FROM mm WHERE e <= 13 AND n >= 13 AND abs(m) > 1e-15 GROUP BY factor) SELECT f.factor, round(fr, 6) AS fraction, coalesce(fr > 0.75, false) AS reversed FROM (SELECT DISTINCT factor FROM FI) f LEFT JOIN r ON r.factor = f.factor")
def ic_style_reversal(spark, folder):
    return rounded(signals.style_reversal(factor_ics(spark, folder), 13))


@query(IC_SQL + ", w AS (SELECT factor, date, ic, count(ic) OVER q AS k, avg(ic) OVER q AS m, stddev_pop(ic) OVER q AS s FROM K WINDOW q AS (PARTITION BY factor ORDER BY date ROWS 11 PRECEDING)), r AS (SELECT factor, avg(s) FILTER (k >= 6) AS a, avg(m / s) FILTER (k >= 6 AND s > 1e-12) AS b, min(m) FILTER (k >= 6) AS d, avg(ic) AS mean FROM w GROUP BY factor), y AS (SELECT factor, year(date) AS yr, avg(ic) AS v FROM K GROUP BY 1, 2), z AS (SELECT y.factor, avg(CASE WHEN abs(mean) > 1e-15 THEN CASE WHEN sign(v) = sign(mean) THEN 1.0 ELSE 0 END END) AS sy FROM y JOIN r ON r.factor = y.factor GROUP BY y.factor) SELECT r.factor, round(a, 6) AS rolling_std, round(b, 5) AS rolling_icir, round(d, 6) AS worst_mean, round(sy, 6) AS same_sign_years FROM r JOIN z ON z.factor = r.factor")
def ic_stability(spark, folder):
    out = signals.stability(factor_ics(spark, folder))
    return out.select("factor", F.round("rolling_std", 6).alias("rolling_std"), F.round("rolling_icir", 5).alias("rolling_icir"), F.round("worst_mean", 6).alias("worst_mean"), F.round("same_sign_years", 6).alias("same_sign_years"))


_LAGS = 12
NW_SQL = IC_SQL + ", ce AS (SELECT factor, date, x, x - avg(x) OVER (PARTITION BY factor) AS e0 FROM K), lg AS (SELECT *, " + ", ".join(f"e0 * lag(e0, {k}) OVER (PARTITION BY factor ORDER BY date) AS g{k}" for k in range(1, _LAGS + 1)) + " FROM ce), gs AS (SELECT factor, avg(x) AS m, count(*) AS n, sum(e0 * e0) AS g0, " + ", ".join(f"coalesce(sum(g{k}), 0) AS g{k}" for k in range(1, _LAGS + 1)) + f" FROM lg GROUP BY factor), ll AS (SELECT *, CAST(least(greatest(floor(4 * pow(n / 100, 2.0 / 9)), 1), {_LAGS}) AS INTEGER) AS lags FROM gs), vv AS (SELECT *, (g0 + " + " + ".join(f"CASE WHEN lags >= {k} THEN 2 * (1 - {k} / (lags + 1)) * g{k} ELSE 0 END" for k in range(1, _LAGS + 1)) + ") / (n * n) AS v FROM ll), NW AS (SELECT factor, n, lags, CASE WHEN n >= 3 AND v > 0 THEN m / sqrt(v) END AS nw_t FROM vv)"


@query(NW_SQL + " SELECT factor, n, lags, round(nw_t, 5) AS nw_t FROM NW")
def nw_default_lags(spark, folder):
    return rounded(signals.newey_west_default(factor_ics(spark, folder)), 5)


DIR_SQL = IC_SQL + ", dm AS (SELECT factor, avg(ic) AS m FROM K GROUP BY factor), tg AS (SELECT FR.factor, FR.date, fwd, coalesce(FR.x * (CASE WHEN abs(m) < 1e-12 THEN 1 ELSE sign(m) END) > 0, false) AS hit FROM FR JOIN dm ON dm.factor = FR.factor WHERE fwd IS NOT NULL), tdy AS (SELECT factor, date, count(*) AS n, count(*) FILTER (hit) AS k, avg(fwd) FILTER (hit) - avg(fwd) AS edge FROM tg GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (hit) >= 3), TP AS (SELECT factor, avg(CASE WHEN edge > 1e-15 THEN 1.0 ELSE 0 END) AS payoff_hit, avg(edge) AS payoff_edge, count(*) AS n_days FROM tdy GROUP BY factor)"


def triggers(spark, folder, panel=None, series=None):
    panel = stored_scores(spark, folder) if panel is None else panel
    series = factor_ics(spark, folder, panel) if series is None else series
    means = series.groupBy("factor").agg(F.avg("ic").alias("direction"))  # one row for each factor
    return signals.trigger_summary(factor_rows(spark, folder, panel).join(F.broadcast(means), "factor"), "x", "fwd", c("direction"), 3)


@query(DIR_SQL + " SELECT factor, round(payoff_hit, 6) AS payoff_hit, round(payoff_edge, 6) AS payoff_edge, n_days FROM TP")
def trigger_payoff_summary(spark, folder):
    return rounded(triggers(spark, folder))


QS_SQL = SCORE_SQL + ", qk AS (SELECT date, fwd, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score, code) AS r FROM S WHERE score IS NOT NULL AND fwd IS NOT NULL), qb AS (SELECT date, n, fwd, floor((r - 1) * 5 / n) AS b FROM qk WHERE n >= 5), QD AS (SELECT date, count(*) AS n, avg(fwd) FILTER (b = 0) AS low, avg(fwd) FILTER (b = 4) AS high, avg(fwd) FILTER (b = 4) - avg(fwd) AS long_excess, avg(fwd) - avg(fwd) FILTER (b = 0) AS short_contribution, avg(fwd) FILTER (b = 4) - avg(fwd) FILTER (b = 0) AS spread FROM qb GROUP BY date)"


@query(QS_SQL + " SELECT date, n, round(low, 6) AS low, round(high, 6) AS high, round(long_excess, 6) AS long_excess, round(short_contribution, 6) AS short_contribution, round(spread, 6) AS spread FROM QD")
def quantile_long_short(spark, folder):
    return rounded(signals.quantile_spread(scored(spark, folder), "score", "fwd", 5, 5))


@query(QS_SQL + ", m AS (SELECT avg(low) AS low, avg(high) AS high, avg(long_excess) AS le, avg(short_contribution) AS sc, avg(spread) AS spread, count(*) AS n_days FROM QD) SELECT round(low, 6) AS low, round(high, 6) AS high, round(le, 6) AS long_excess, round(sc, 6) AS short_contribution, round(spread, 6) AS spread, n_days, round(CASE WHEN le + sc > 1e-12 THEN le / (le + sc) END, 5) AS long_share, CASE WHEN le + sc <= 1e-12 THEN 'none' WHEN le / (le + sc) > 0.65 THEN 'long' WHEN le / (le + sc) < 0.35 THEN 'short' ELSE 'both' END AS source FROM m")
def quantile_long_short_summary(spark, folder):
    out = signals.spread_summary(signals.quantile_spread(scored(spark, folder), "score", "fwd", 5, 5))
    return out.select(*[F.round(n, 6).alias(n) for n in ("low", "high", "long_excess", "short_contribution", "spread")], "n_days", F.round("long_share", 5).alias("long_share"), "source")


PHI = "(1 - 0.5 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * 2 * (1 / (1 + 0.2316419 * {z})) * (0.319381530 + (1 / (1 + 0.2316419 * {z})) * (-0.356563782 + (1 / (1 + 0.2316419 * {z})) * (1.781477937 + (1 / (1 + 0.2316419 * {z})) * (-1.821255978 + (1 / (1 + 0.2316419 * {z})) * 1.330274429)))))"


@query(DIR_SQL + NW_SQL.removeprefix(IC_SQL) + TREND_SQL.removeprefix(IC_SQL) + RETENTION_SQL.removeprefix(IC_SQL) + f""", st AS (SELECT factor, avg(x) AS m, {_ratio()} AS icir, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0 END) AS up, avg(CASE WHEN ic < -1e-12 THEN 1.0 ELSE 0 END) AS down FROM K GROUP BY factor),
pv AS (SELECT NW.factor, 2 * (1 - {PHI.format(z='abs(nw_t)')}) AS p FROM NW), pk AS (SELECT *, row_number() OVER (ORDER BY p, factor) AS k, count(*) OVER () AS nf FROM pv), ps AS (SELECT factor, k <= coalesce((SELECT max(k) FROM pk WHERE p <= k * 0.05 / nf), 0) AS sig FROM pk)
SELECT st.factor, coalesce(abs(m) >= 0.015 AND abs(icir) >= 0.3 AND sig, false) AS dense, coalesce(abs(m) >= 0.015 AND abs(icir) >= 0.2 AND (CASE WHEN m < -1e-12 THEN down ELSE up END) >= 0.56 AND payoff_hit >= 0.55, false) AS sparse, coalesce(NOT (abs(m) >= 0.015 AND abs(icir) >= 0.3) AND sig AND abs(icir_recent) >= 0.35 AND abs(icir_recent) / CASE WHEN abs(icir_past) > 1e-12 THEN abs(icir_past) END >= 1.5 AND rising, false) AS emerging
FROM st LEFT JOIN ps ON ps.factor = st.factor LEFT JOIN TP ON TP.factor = st.factor LEFT JOIN RT ON RT.factor = st.factor LEFT JOIN TD ON TD.factor = st.factor""")
def factor_tracks(spark, folder):
    """Which factors pass the dense, the sparse and the emerging gate; one row for each factor."""
    panel = stored_scores(spark, folder)
    # A row for each factor and date, which five statistics read.
    series = written(factor_ics(spark, folder, panel), "coefficients")
    stats = ic.ic_stats(series, "factor").select("factor", "ic_mean", "icir", "win_rate")
    found = ic.benjamini_hochberg(signals.newey_west_default(series), "nw_t").select("factor", "significant")
    joined = stats.join(found, "factor", "left").join(triggers(spark, folder, panel, series), "factor", "left").join(signals.retention(series, 26), "factor", "left").join(signals.segment_trend(series, 20), "factor", "left")
    return joined.select(
        "factor", signals.dense_gate(c("ic_mean"), c("icir"), c("significant")).alias("dense"), signals.sparse_gate(c("ic_mean"), c("icir"), c("win_rate"), c("payoff_hit")).alias("sparse"),
        signals.emerging(c("ic_mean"), c("icir"), c("icir_recent"), c("retention"), c("significant"), c("rising")).alias("emerging"),
    )


@query(SCORE_SQL + ", hz AS (SELECT h.h AS horizon, code, date, close, open, score FROM S, (SELECT unnest([1, 2, 4, 8, 13]) AS h) h), hf AS (SELECT horizon, date, code, score, CASE horizon " + " ".join(f"WHEN {h} THEN lead(close, {h}) OVER (PARTITION BY horizon, code ORDER BY date)" for h in (1, 2, 4, 8, 13)) + " END / CASE WHEN lead(open, 1) OVER (PARTITION BY horizon, code ORDER BY date) <> 0 THEN lead(open, 1) OVER (PARTITION BY horizon, code ORDER BY date) END - 1 AS fwd FROM hz), hr AS (SELECT horizon, date, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY horizon, date, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY horizon, date, score) - 1) / 2.0 END AS a, CASE WHEN fwd IS NOT NULL THEN rank() OVER (PARTITION BY horizon, date, fwd IS NULL ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, date, fwd) - 1) / 2.0 END AS b FROM hf), hi AS (SELECT horizon, date, corr(a, b) AS ic FROM hr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5), hd2 AS (SELECT horizon, abs(avg(greatest(least(ic, 0.3), -0.3))) AS v FROM hi WHERE isfinite(ic) GROUP BY horizon), pkk AS (SELECT *, max(v) OVER () AS peak, lag(v) OVER (ORDER BY horizon) AS v0, lag(horizon) OVER (ORDER BY horizon) AS h0, max(horizon) OVER () AS longest FROM hd2), pl AS (SELECT *, min(CASE WHEN v = peak THEN horizon END) OVER () AS ap FROM pkk) SELECT 'score' AS factor, round(coalesce(arg_min(CASE WHEN v0 = v THEN horizon ELSE h0 + (peak / 2 - v0) / (v - v0) * (horizon - h0) END, horizon) FILTER (horizon > ap AND v <= peak / 2), max(longest)), 4) AS half_life FROM pl")
def ic_half_life(spark, folder):
    decay = ic.ic_decay(scored(spark, folder), "score", "close", "open", [1, 2, 4, 8, 13], 5)
    return signals.half_life(decay.select(F.lit("score").alias("factor"), "horizon", F.abs("ic_mean").alias("abs_ic"))).select("factor", F.round("half_life", 4).alias("half_life"))
