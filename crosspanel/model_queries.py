"""Queries of factor choice, scores, weights and the stream's versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import crosssection as cs
from .functions import timeseries as ts
from .operators import ic, scoring, selection
from .plans import series
from .queries import CODE, SCORE_SQL, c, frame_sql, query, rounded, scored
from .sources.store import written

_FACTORS = {"reversal": "score", "size": "-amount", "range": "(high - low) / open"}


def stored_scores(spark, folder):
    """What three factors read of the scored panel, written once for queries that read it several times."""
    return written(scored(spark, folder).select("date", "code", "score", "amount", "high", "low", "open", "fwd"), "factor_panel")


def factor_rows(spark, folder, panel=None):
    """Three factors of the panel as rows: date, code, factor, x, fwd."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.expr(e).alias("x")) for n, e in _FACTORS.items()])).alias("o")
    panel = scored(spark, folder) if panel is None else panel
    return panel.select("date", "code", "fwd", cells).select("date", "code", "o.factor", "o.x", "fwd")


def factor_ics(spark, folder, panel=None):
    rows = factor_rows(spark, folder, panel).where("x is not null and fwd is not null")
    return ic.ic_series(rows, "x", "fwd", 5, ("factor", "date"))


ROWS_SQL = SCORE_SQL + ", FR AS (" + " UNION ALL ".join(f"SELECT '{n}' AS factor, date, code, {e} AS x, fwd FROM S" for n, e in _FACTORS.items()) + "), FK AS (SELECT * FROM FR WHERE x IS NOT NULL AND fwd IS NOT NULL), " + """
RK AS (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY x) + (count(*) OVER (PARTITION BY factor, date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, date, fwd) - 1) / 2.0 AS b FROM FK),
FI0 AS (SELECT factor, date, corr(a, b) AS ic, count(*) AS n FROM RK GROUP BY factor, date HAVING count(*) >= 5), FI AS (SELECT factor, date, CASE WHEN isfinite(ic) THEN ic END AS ic, n FROM FI0)"""
PAST = "OVER (PARTITION BY factor ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)"
STAT_SQL = ROWS_SQL + f", RS0 AS (SELECT factor, date, count(ic) {PAST} AS n, avg(ic) {PAST} AS mean, stddev_pop(ic) {PAST} AS std FROM FI), RS AS (SELECT factor, date, n, mean, mean / CASE WHEN std > 1e-12 THEN std END AS icir FROM RS0)"


@query(ROWS_SQL + " SELECT factor, date, round(ic, 6) AS ic, n FROM FI")
def factor_ic(spark, folder):
    return rounded(factor_ics(spark, folder))


@query(STAT_SQL + " SELECT factor, date, n, round(mean, 6) AS mean, round(icir, 5) AS icir, coalesce(n >= 52 AND abs(mean) >= 0.015 AND abs(icir) >= 0.3, false) AS passes FROM RS")
def rolling_gate(spark, folder):
    out = selection.rolling_stats(factor_ics(spark, folder))
    return out.select("factor", "date", "n", F.round("mean", 6).alias("mean"), F.round("icir", 5).alias("icir"), selection.passes_gate(c("mean"), c("icir"), c("n")).alias("passes"))


@query(ROWS_SQL + """, PP AS (SELECT a.factor, b.factor AS other, count(*) AS n, corr(a.ic, b.ic) AS corr FROM FI a JOIN FI b ON a.date = b.date AND a.factor < b.factor WHERE a.ic IS NOT NULL AND b.ic IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT factor, other, n, round(corr, 6) AS corr FROM PP""")
def ic_correlation(spark, folder):
    return rounded(selection.ic_correlations(factor_ics(spark, folder)))


@query(ROWS_SQL + """, K AS (SELECT factor, ic, row_number() OVER (PARTITION BY factor ORDER BY date DESC) <= 52 AS late FROM FI WHERE ic IS NOT NULL),
G AS (SELECT factor, abs(avg(ic) FILTER (late) / stddev_pop(ic) FILTER (late)) AS r, abs(avg(ic) FILTER (NOT late) / stddev_pop(ic) FILTER (NOT late)) AS p FROM K GROUP BY factor)
SELECT factor, round(r, 5) AS recent_icir, round(p, 5) AS past_icir, round(r / p, 3) AS retention FROM G""")
def ic_retention(spark, folder):
    out = selection.recent_retention(factor_ics(spark, folder), 52)
    return out.select("factor", F.round("recent_icir", 5).alias("recent_icir"), F.round("past_icir", 5).alias("past_icir"), F.round("retention", 3).alias("retention"))


@query(ROWS_SQL + """, K AS (SELECT factor, ic, row_number() OVER (PARTITION BY factor ORDER BY date) <= count(*) OVER (PARTITION BY factor) // 2 AS early FROM FI WHERE ic IS NOT NULL)
SELECT factor, round(avg(ic) FILTER (early), 6) AS early, round(avg(ic) FILTER (NOT early), 6) AS late, round(CASE WHEN count(*) >= 8 AND abs(avg(ic) FILTER (early)) >= 1e-12 THEN abs(avg(ic) FILTER (NOT early)) / abs(avg(ic) FILTER (early)) END, 5) AS ratio FROM K GROUP BY factor""")
def early_late(spark, folder):
    out = selection.early_late_ratio(factor_ics(spark, folder))
    return out.select("factor", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), F.round("ratio", 5).alias("ratio"))


@query(STAT_SQL + """, DD AS (SELECT factor, date, month(date) <> lag(month(date)) OVER (PARTITION BY factor ORDER BY date) AS due, n, mean, icir FROM RS), SC AS (SELECT date, factor FROM DD WHERE due AND n >= 52 AND abs(mean) >= 0.015),
X AS (SELECT d.date, max(s.date) AS at FROM (SELECT DISTINCT date FROM P) d JOIN (SELECT DISTINCT date FROM SC) s ON s.date <= d.date GROUP BY d.date)
SELECT X.date, factor FROM X JOIN SC ON SC.date = X.at""")
def pool_schedule(spark, folder):
    stats = selection.rolling_stats(factor_ics(spark, folder))
    due = F.month("date") != F.lag(F.month("date")).over(ts.whole("factor"))
    schedule = stats.withColumn("due", due).where("due and n >= 52 and abs(mean) >= 0.015").select("date", "factor")
    return selection.active_pool(schedule, scored(spark, folder).select("date"))


def _z_sql(x: str) -> str:
    over = "OVER (PARTITION BY date)"
    return f"greatest(least(({x} - avg({x}) {over}) / CASE WHEN stddev_pop({x}) {over} > 1e-12 THEN stddev_pop({x}) {over} END, 3.0), -3.0)"


@query(SCORE_SQL + f", Z AS (SELECT date, code, CASE WHEN score IS NOT NULL THEN {_z_sql('score')} END AS a, CASE WHEN amount IS NOT NULL THEN {_z_sql('amount')} END AS b FROM S) SELECT date, code, round(CASE WHEN coalesce(a, b) IS NOT NULL THEN coalesce(a, 0) * 0.7 - coalesce(b, 0) * 0.3 END, 6) AS score FROM Z")
def linear_score(spark, folder):
    panel = scored(spark, folder).select("date", "code", cs.cs_zscore(c("score")).alias("a"), cs.cs_zscore(c("amount")).alias("b"))
    return rounded(panel.select("date", "code", scoring.linear_score({"a": 0.7, "b": -0.3}).alias("score")))


def _rank(x: str) -> str:
    part = f"PARTITION BY date, {x} IS NULL"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({part}, {x}) - 1) / 2.0) / count(*) OVER ({part}) END"


@query(f", H AS (SELECT date, code, close / lag(close, 1) {CODE} - 1 AS a, close / lag(close, 4) {CODE} - 1 AS b FROM P), HR AS (SELECT date, code, {_rank('a')} AS a, {_rank('b')} AS b FROM H)"
       " SELECT date, code, round((coalesce(a, 0) + 2 * coalesce(b, 0)) / CASE WHEN coalesce(a, b) IS NOT NULL THEN CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN b IS NOT NULL THEN 2 ELSE 0 END END, 6) AS score FROM HR")
def multi_horizon(spark, folder):
    panel = scored(spark, folder).select("date", "code", (c("close") / ts.delay(c("close"), 1) - 1).alias("a"), (c("close") / ts.delay(c("close"), 4) - 1).alias("b"))
    return rounded(panel.select("date", "code", scoring.multi_horizon(["a", "b"], [1.0, 2.0]).alias("score")))


@query(STAT_SQL + """, Z AS (SELECT factor, date, code, x, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM FR WINDOW w AS (PARTITION BY factor, date)),
J AS (SELECT Z.date, code, icir, greatest(least((x - m) / s, 3.0), -3.0) AS z FROM Z JOIN RS ON RS.factor = Z.factor AND RS.date = Z.date WHERE s > 1e-12 AND x IS NOT NULL AND icir IS NOT NULL)
SELECT date, code, round(sum(icir * z) / CASE WHEN sum(abs(icir)) > 0 THEN sum(abs(icir)) END, 5) AS score FROM J GROUP BY date, code""")
def dynamic_score(spark, folder):
    panel = stored_scores(spark, folder)
    stats = selection.rolling_stats(factor_ics(spark, folder, panel))
    sections = panel.select("date", "code", *[F.expr(e).cast("double").alias(n) for n, e in _FACTORS.items()])
    standard = series.with_series(sections, {f"z_{n}": ("z", (n,), (3.0,)) for n in _FACTORS}, "date", "code")
    return rounded(scoring.dynamic_score_wide(standard, {n: f"z_{n}" for n in _FACTORS}, stats), 5)


@query(SCORE_SQL + """, K AS (SELECT date, code, score, score - min(score) OVER (PARTITION BY date) + 1e-8 AS lifted, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY date) AS n, exp((score - max(score) OVER (PARTITION BY date)) / 0.5) AS e FROM S WHERE score IS NOT NULL)
SELECT date, code, round(lifted / sum(lifted) OVER (PARTITION BY date), 6) AS by_score, round(r / (n * (n + 1) / 2.0), 6) AS by_rank, round(e / sum(e) OVER (PARTITION BY date), 6) AS by_softmax FROM K""")
def score_weights(spark, folder):
    known = scored(spark, folder).where("score is not null")
    return rounded(known.select("date", "code", scoring.score_weights(c("score")).alias("by_score"), scoring.rank_weights(c("score")).alias("by_rank"), scoring.softmax(c("score"), "date", 0.5).alias("by_softmax")))


@query(SCORE_SQL + """, M AS (SELECT code, count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe FROM S WHERE ret IS NOT NULL GROUP BY code) SELECT code, n, round(sharpe, 5) AS sharpe FROM M""")
def sharpe_of_codes(spark, folder):
    return scoring.probabilistic_sharpe(scored(spark, folder), "code").select("code", "n", F.round("sharpe", 5).alias("sharpe"))


_TAIL = "(exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))"


@query(SCORE_SQL + f""", m AS (SELECT code, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp FROM S GROUP BY code), q AS (SELECT S.code, m.n, mu / CASE WHEN sd > 1e-12 THEN sd END AS sr, avg(pow((ret - mu) / sp, 3)) AS skew, avg(pow((ret - mu) / sp, 4)) AS kurt FROM S JOIN m ON m.code = S.code WHERE ret IS NOT NULL GROUP BY S.code, m.n, mu, sd),
u AS (SELECT code, n, sr, sr * sqrt(n - 1) / sqrt(CASE WHEN 1 - skew * sr + (kurt - 1) / 4 * sr * sr > 0 THEN 1 - skew * sr + (kurt - 1) / 4 * sr * sr END) AS zs FROM q), x AS (SELECT *, abs(zs) AS z, 1 / (1 + 0.2316419 * abs(zs)) AS k FROM u)
SELECT code, n, round(sr, 5) AS sharpe, round(CASE WHEN zs >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END, 5) AS psr FROM x""")
def probabilistic_sharpe(spark, folder):
    return rounded(scoring.probabilistic_sharpe(scored(spark, folder), "code"), 5)


@query(f", V AS (SELECT code, date, count(close) {frame_sql(12)} AS n, skewness(close) {frame_sql(12)} AS s FROM P) SELECT code, date, round(CASE WHEN n >= 8 AND isfinite(s) THEN s END, 4) AS skew FROM V")
def ts_skew(spark, folder):
    from .sources.panel import weekly_panel

    return rounded(weekly_panel(spark, folder).select("code", "date", ts.ts_skew(c("close"), 12, 8).alias("skew")), 4)
