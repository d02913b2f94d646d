"""Queries of coefficients freed of controls, of regressions on the market with decaying weights and of the risk styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .model_queries import _FACTORS, factor_rows
from .operators import asof, pure_ic, risk_styles
from .queries import RET_SQL, SCORE_SQL, SEGMENTS_SQL, c, query, ret_panel, rounded, scored, yearly_segments
from .universe_queries import CAP, sized

# Controls: log of the amount and the reversal of the week before, dummies of the segment in force, weights by the root of the amount.
_CONTROLS = ["log_amount", "before"]


def controlled_rows(spark, folder, least: int = 3):
    """Three factors with the controls as of their date; small segments of a date are put together."""
    panel = scored(spark, folder)
    controls = panel.select("code", "date", F.ln("amount").alias("log_amount"), F.lag("score").over(asof.Window.partitionBy("code").orderBy("date")).alias("before"), F.sqrt("amount").alias("w"))
    controls = asof.segment_as_of(controls, yearly_segments(spark, folder), ["sw_l2"])
    controls = pure_ic.collapsed_groups(controls, "sw_l2", least)
    return factor_rows(spark, folder).join(controls, ["code", "date"])


CONTROLS_SQL = SCORE_SQL + SEGMENTS_SQL + """, sg0 AS (SELECT P.code, P.date, arg_max(sw_l2, effective_date) AS sw FROM P JOIN seg ON seg.code = P.code AND effective_date <= date AND (end_date IS NULL OR date <= end_date) GROUP BY 1, 2),
sg1 AS (SELECT P.code, P.date, coalesce(sw, 'none') AS sw FROM P LEFT JOIN sg0 ON sg0.code = P.code AND sg0.date = P.date),
SG AS (SELECT code, date, CASE WHEN count(*) OVER (PARTITION BY date, sw) < 3 THEN 'other' ELSE sw END AS g FROM sg1),
CT AS (SELECT S.code, S.date, ln(amount) AS x0, lag(score) OVER (PARTITION BY S.code ORDER BY S.date) AS x1, sqrt(amount) AS w, g FROM S JOIN SG ON SG.code = S.code AND SG.date = S.date)"""
PURE_SQL = CONTROLS_SQL + ", FR AS (" + " UNION ALL ".join(f"SELECT '{n}' AS factor, date, code, {e} AS x, fwd FROM S" for n, e in _FACTORS.items()) + """),
k0 AS (SELECT factor, FR.date, FR.code, x, fwd, coalesce(x0, 0) AS x0, coalesce(x1, 0) AS x1, g, CASE WHEN w > 0 THEN w END AS w FROM FR JOIN CT ON CT.code = FR.code AND CT.date = FR.date WHERE x IS NOT NULL AND fwd IS NOT NULL),
k1 AS (SELECT *, count(*) OVER (PARTITION BY factor, date) AS n, coalesce(w, quantile_cont(w, 0.5) OVER (PARTITION BY factor, date), 1) AS ww FROM k0),
k2 AS (SELECT factor, date, code, fwd, n, ww, x - sum(ww * x) OVER i / sum(ww) OVER i AS x, fwd - sum(ww * fwd) OVER i / sum(ww) OVER i AS y, x0 - sum(ww * x0) OVER i / sum(ww) OVER i AS x0, x1 - sum(ww * x1) OVER i / sum(ww) OVER i AS x1 FROM k1 WHERE n >= {least} WINDOW i AS (PARTITION BY factor, date, g)),
b0 AS (SELECT factor, date, sum(ww * x0 * x0) AS a, sum(ww * x0 * x1) AS b, sum(ww * x1 * x1) AS d, sum(ww * x0 * x) AS p, sum(ww * x1 * x) AS q, sum(ww * x0 * y) AS r, sum(ww * x1 * y) AS s FROM k2 GROUP BY factor, date),
RS AS (SELECT k2.factor, k2.date, code, fwd, x - CASE WHEN a * d - b * b > 1e-9 * a * d THEN x0 * (p * d - q * b) / (a * d - b * b) + x1 * (a * q - b * p) / (a * d - b * b) ELSE x0 * p / a END AS res, y - CASE WHEN a * d - b * b > 1e-9 * a * d THEN x0 * (r * d - s * b) / (a * d - b * b) + x1 * (a * s - b * r) / (a * d - b * b) ELSE x0 * r / a END AS yres FROM k2 JOIN b0 ON b0.factor = k2.factor AND b0.date = k2.date),
RR AS (SELECT *, rank() OVER (PARTITION BY factor, date ORDER BY round(res, 9)) + (count(*) OVER (PARTITION BY factor, date, round(res, 9)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, date, fwd) - 1) / 2.0 AS b FROM RS),
PI AS (SELECT factor, date, corr(a, b) AS ic, count(*) AS n FROM RR GROUP BY factor, date)"""
LEAST = 30


def pure_series(spark, folder):
    return pure_ic.pure_ic(controlled_rows(spark, folder), "x", "fwd", _CONTROLS, "sw_l2", "w", LEAST)


@query(CONTROLS_SQL + " SELECT code, date, round(x0, 6) AS log_amount, round(x1, 6) AS \"before\", round(w, 6) AS w, g AS sw_l2 FROM CT")
def pure_controls(spark, folder):
    """Controls as of each date, with the dummies' groups."""
    return rounded(controlled_rows(spark, folder).where("factor = 'size'").select("code", "date", *_CONTROLS, "w", "sw_l2"))


@query(PURE_SQL.replace("{least}", str(LEAST)) + " SELECT factor, date, code, round(res, 4) AS res FROM RS")
def pure_residuals(spark, folder):
    rows = controlled_rows(spark, folder).where("fwd is not null")
    return rounded(pure_ic.residuals(rows, ["x"], _CONTROLS, "sw_l2", "w", LEAST).select("factor", "date", "code", c("x_res").alias("res")), 4)


@query(PURE_SQL.replace("{least}", str(LEAST)) + " SELECT factor, date, round(ic, 6) AS ic, n FROM PI")
def pure_ic_series(spark, folder):
    return rounded(pure_series(spark, folder))


@query(PURE_SQL.replace("{least}", str(LEAST)) + " SELECT factor, round(avg(ic), 6) AS pure_ic, count(ic) AS n FROM PI GROUP BY factor")
def pure_ic_run(spark, folder):
    return rounded(pure_ic.pure_means(pure_series(spark, folder)))


@query(PURE_SQL.replace("{least}", str(LEAST)) + """, sn AS (SELECT factor, CASE WHEN avg(ic) < 0 THEN -1 ELSE 1 END AS sign FROM PI GROUP BY factor), q0 AS (SELECT RS.factor, date, code, yres, sign, round(res, 9) * sign AS r, count(*) OVER (PARTITION BY RS.factor, date) AS n FROM RS JOIN sn ON sn.factor = RS.factor),
q1 AS (SELECT *, floor((row_number() OVER (PARTITION BY factor, date ORDER BY r, code) - 1) * 5 / n) AS k FROM q0), q2 AS (SELECT factor, date, sign, count(*) AS n, avg(yres) FILTER (k = 0) AS low, avg(yres) FILTER (k = 4) AS high, avg(yres) AS al FROM q1 GROUP BY 1, 2, 3)
SELECT factor, date, sign, n, round(low, 6) AS low, round(high, 6) AS high, round(high - al, 6) AS long_excess, round(al - low, 6) AS short_contribution, round(high - low, 6) AS spread FROM q2""")
def pure_quantile_spread(spark, folder):
    """Highest and lowest fifth of the residual, turned to a positive mean coefficient, by the label's own residual."""
    return rounded(pure_ic.pure_spread(controlled_rows(spark, folder), "x", "fwd", _CONTROLS, "sw_l2", "w", 5, LEAST))


@query(", m AS (SELECT code, date, ln(amount) AS v FROM P WHERE amount > 0 AND CAST(code AS INTEGER) % 3 > 0), z AS (SELECT code, date, v, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM m WINDOW w AS (PARTITION BY date)) SELECT P.code, P.date, round(CASE WHEN n >= 2 THEN CASE WHEN s < 1e-12 THEN 0 ELSE (v - m) / CASE WHEN s >= 1e-12 THEN s END END END, 6) AS size FROM P LEFT JOIN z ON z.code = P.code AND z.date = P.date WHERE CAST(P.code AS INTEGER) % 3 > 0")
def pool_size_control(spark, folder):
    """Standardised log of the amount within a pool of two thirds of the codes."""
    pool = pure_ic.pool_size(scored(spark, folder), "amount", c("code").cast("int") % 3 > 0)
    return rounded(pool.select("code", "date", "size"))


MARKET_SQL = """, mk AS (SELECT date, avg(ret) AS m FROM R GROUP BY date), mr AS (SELECT code, R.date, row_number() OVER (PARTITION BY code ORDER BY R.date) AS t, CASE WHEN ret IS NOT NULL AND m IS NOT NULL THEN ret END AS r, CASE WHEN ret IS NOT NULL AND m IS NOT NULL THEN m END AS m FROM R JOIN mk ON mk.date = R.date),
ew AS (SELECT a.code, a.date, a.t, count(b.r) FILTER (b.t > a.t - 252) AS n, sum(CASE WHEN b.r IS NOT NULL THEN pow(0.5, (a.t - b.t) / 63.0) END) AS w, sum(b.r * pow(0.5, (a.t - b.t) / 63.0)) AS sr, sum(b.m * pow(0.5, (a.t - b.t) / 63.0)) AS sm, sum(b.r * b.r * pow(0.5, (a.t - b.t) / 63.0)) AS srr, sum(b.m * b.m * pow(0.5, (a.t - b.t) / 63.0)) AS smm, sum(b.r * b.m * pow(0.5, (a.t - b.t) / 63.0)) AS srm FROM mr a JOIN mr b ON a.code = b.code AND b.t <= a.t GROUP BY 1, 2, 3),
ev AS (SELECT code, date, n, greatest(srr / w - sr / w * (sr / w), 0) AS vr, greatest(smm / w - sm / w * (sm / w), 0) AS vm, srm / w - sr / w * (sm / w) AS c FROM ew),
MB AS (SELECT code, date, CASE WHEN n >= 126 AND vm > 0 THEN c / vm END AS beta, CASE WHEN n >= 126 AND vm > 0 THEN sqrt(greatest(vr - c / vm * (c / vm) * vm, 0)) END AS hsigma FROM ev)"""


def with_market(spark, folder):
    """Returns and their mean over all codes of the date as the market's."""
    panel = ret_panel(spark, folder)
    market = panel.groupBy("date").agg(F.avg("ret").alias("market"))  # one row for each date
    return panel.join(F.broadcast(market), "date")


@query(RET_SQL + MARKET_SQL + " SELECT code, date, round(beta, 6) AS beta, round(hsigma, 6) AS hsigma FROM MB")
def decayed_market_beta(spark, folder):
    """Regression on the market with weights that halve in 63 rows, of codes with half a window of 252 rows."""
    return rounded(risk_styles.market_regression(with_market(spark, folder).select("code", "date", "ret", "market"), "ret", "market").select("code", "date", "beta", "hsigma"))


MOMENTUM_SQL = """, lr AS (SELECT code, date, row_number() OVER w AS t, lag(CASE WHEN ret IS NOT NULL THEN ln(1 + greatest(ret, -0.999)) END, 20) OVER w AS x FROM R WINDOW w AS (PARTITION BY code ORDER BY date)),
mo0 AS (SELECT a.code, a.date, sum(b.x * pow(0.5, (a.t - b.t) / 60.0)) AS s, sum(CASE WHEN b.x IS NOT NULL THEN pow(0.5, (a.t - b.t) / 60.0) END) AS k FROM lr a JOIN lr b ON a.code = b.code AND b.t <= a.t AND b.t > a.t - 240 GROUP BY 1, 2),
MO AS (SELECT code, date, CASE WHEN k >= 0.5 * (SELECT sum(pow(0.5, d / 60.0)) FROM range(240) g(d)) * (1 - 1e-12) THEN s / k END AS momentum FROM mo0)"""


@query(RET_SQL + MOMENTUM_SQL + " SELECT code, date, round(momentum, 6) AS momentum FROM MO")
def decayed_momentum(spark, folder):
    """Half-life mean of log returns over 240 rows, the last 20 left out."""
    late = ret_panel(spark, folder).withColumn("late", F.lag(risk_styles.log_return(c("ret")), 20).over(asof.Window.partitionBy("code").orderBy("date")))
    return rounded(risk_styles.halflife_mean(late.select("code", "date", "late"), c("late"), 240, 60, "momentum").select("code", "date", "momentum"))


def _standard(table: str, names: list[str]) -> str:
    """SQL: the columns clipped at the date's hundredths, then standardised and held within three deviations, of a table with code and date."""
    clip = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN greatest(least({n}, quantile_cont({n}, 0.99) OVER d), quantile_cont({n}, 0.01) OVER d) END AS {n}" for n in names)
    z = ", ".join(f"CASE WHEN {n} IS NOT NULL AND stddev_pop({n}) OVER d > 1e-12 THEN greatest(least(({n} - avg({n}) OVER d) / CASE WHEN stddev_pop({n}) OVER d > 1e-12 THEN stddev_pop({n}) OVER d END, 3), -3) END AS {n}" for n in names)
    return f"(SELECT code, date, {z} FROM (SELECT code, date, {clip} FROM {table} WINDOW d AS (PARTITION BY date)) WINDOW d AS (PARTITION BY date))"


STYLES_SQL = CAP + """, R AS (SELECT C.*, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM C)""" + MARKET_SQL + MOMENTUM_SQL + f""",
tv AS (SELECT code, date, cap, amount / cap AS turn FROM C), tw AS (SELECT code, date, CASE WHEN cap > 0 THEN ln(cap) END AS size, {", ".join(f"CASE WHEN count(turn) OVER (PARTITION BY code ORDER BY date ROWS {w - 1} PRECEDING) >= {w // 2} AND avg(turn) OVER (PARTITION BY code ORDER BY date ROWS {w - 1} PRECEDING) > 0 THEN ln(avg(turn) OVER (PARTITION BY code ORDER BY date ROWS {w - 1} PRECEDING)) END AS t{w}" for w in (63, 252))} FROM tv),
lq AS {_standard('tw', ['t63', 't252'])}, s0 AS (SELECT tw.code, tw.date, size, beta, hsigma AS res_vol, momentum, (lq.t63 + lq.t252) / 2 AS liquidity FROM tw JOIN MB ON MB.code = tw.code AND MB.date = tw.date JOIN MO ON MO.code = tw.code AND MO.date = tw.date JOIN lq ON lq.code = tw.code AND lq.date = tw.date),
s1 AS {_standard('s0', ['size', 'beta', 'res_vol', 'momentum', 'liquidity'])}, s2 AS (SELECT code, date, CASE WHEN size IS NOT NULL AND count(size) OVER (PARTITION BY date) >= 30 AND var_pop(size) OVER (PARTITION BY date) > 0 THEN size * size - (regr_intercept(size * size, size) OVER (PARTITION BY date) + regr_slope(size * size, size) OVER (PARTITION BY date) * size) END AS nonlin_size FROM s1), s3 AS {_standard('s2', ['nonlin_size'])}"""


@query(STYLES_SQL + " SELECT s1.code, s1.date, round(size, 5) AS size, round(nonlin_size, 5) AS nonlin_size, round(beta, 5) AS beta, round(res_vol, 5) AS res_vol, round(momentum, 5) AS momentum, round(liquidity, 5) AS liquidity FROM s1 JOIN s3 ON s3.code = s1.code AND s3.date = s1.date")
def risk_style_factors(spark, folder):
    panel = sized(spark, folder)
    panel = panel.withColumns({"ret": c("close") / F.lag("close").over(asof.Window.partitionBy("code").orderBy("date")) - 1, "turnover": c("amount") / c("cap")})
    market = panel.groupBy("date").agg(F.avg("ret").alias("market"))
    styled = risk_styles.with_styles(panel.join(F.broadcast(market), "date").select("code", "date", "cap", "ret", "market", "turnover"))
    return rounded(styled.select("code", "date", "size", "nonlin_size", "beta", "res_vol", "momentum", "liquidity"), 5)
