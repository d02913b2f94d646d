"""Queries of redundancy between factors and of rotating pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import crosssection as cs
from .model_queries import factor_ics
from .operators import choice, ic, pools, selection
from .queries import SCORE_SQL, c, query, rounded, scored
from .sources.panel import PANEL_SQL
from .sources.store import written

_MANY = {"reversal": "score", "size": "-amount", "range": "(high - low) / open", "body": "(close - open) / open", "high_gap": "high / close - 1", "low_gap": "low / close - 1", "vwap_gap": "amount / volume / close - 1", "volume": "-volume"}


def stored_panel(spark, folder):
    """The columns that the factors read, written once for queries that read them several times."""
    return written(scored(spark, folder).select("code", "date", "open", "high", "low", "close", "volume", "amount", "score", "fwd"), "scored_panel")


def many_factors(panel):
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.expr(e).cast("double").alias("x")) for n, e in _MANY.items()])).alias("o")
    return panel.select("date", "code", "fwd", cells).select("o.factor", "date", "code", "o.x", "fwd")


def many_ics(panel, least: int = 5):
    """Of each factor and date; few rows, which are read several times, so they are written too."""
    return written(ic.ic_series(many_factors(panel).where("x is not null and fwd is not null"), "x", "fwd", least, ("factor", "date")), "coefficients")


def _many_sql(sections: str = "") -> str:
    """Rank correlations of every two factors (PCR) and their summary (PSM), over sections from five codes on; sections: a condition that leaves some out."""
    return SCORE_SQL + ", FM AS (" + " UNION ALL ".join(f"SELECT '{n}' AS factor, date, code, CAST({e} AS DOUBLE) AS x, fwd FROM S" for n, e in _MANY.items()) + f"""),
FX AS (SELECT factor, date, code, x FROM FM WHERE x IS NOT NULL{sections}), bigd AS (SELECT date FROM FX GROUP BY date HAVING count(DISTINCT code) > 5),
pw AS (SELECT a.factor, b.factor AS other, a.date, a.code, a.x, b.x AS y FROM FX a JOIN FX b ON a.date = b.date AND a.code = b.code AND a.factor < b.factor JOIN bigd ON bigd.date = a.date),
pr AS (SELECT factor, other, date, rank() OVER (PARTITION BY factor, other, date ORDER BY x) + (count(*) OVER (PARTITION BY factor, other, date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, other, date ORDER BY y) + (count(*) OVER (PARTITION BY factor, other, date, y) - 1) / 2.0 AS b FROM pw),
pc0 AS (SELECT factor, other, date, corr(a, b) AS corr, count(*) AS n FROM pr GROUP BY 1, 2, 3 HAVING count(*) >= 5), PCR AS (SELECT * FROM pc0 WHERE isfinite(corr)),
PSM AS (SELECT factor, other, avg(corr) AS mean, quantile_cont(corr, 0.95) AS p95, max(abs(corr)) AS most, avg(abs(corr)) AS mean_abs, count(*) AS dates FROM PCR GROUP BY 1, 2)"""


MANY_SQL = _many_sql()


def value_correlations(panel, sections="true"):
    """Of all sections, unless a condition is given."""
    wide = panel.where(sections).select("date", *(F.expr(e).cast("double").alias(n) for n, e in _MANY.items()))
    return written(pools.column_correlations(wide, [*_MANY], 5, block=3), "correlations")


@query(MANY_SQL + " SELECT factor, other, date, round(corr, 6) AS corr, n FROM PCR")
def section_correlation(spark, folder):
    """Rank correlation of every two of eight factors, in blocks of three."""
    return rounded(value_correlations(stored_panel(spark, folder)))


@query(MANY_SQL + " SELECT factor, other, round(mean, 6) AS mean, round(p95, 6) AS p95, round(most, 6) AS most, round(mean_abs, 6) AS mean_abs, dates FROM PSM")
def correlation_summary(spark, folder):
    return rounded(pools.summarised(value_correlations(stored_panel(spark, folder))))


# Coefficients of the eight factors, and their strength.
_IC_SQL = """, mk0 AS (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY x) + (count(*) OVER (PARTITION BY factor, date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, date, fwd) - 1) / 2.0 AS b FROM FM WHERE x IS NOT NULL AND fwd IS NOT NULL),
mi0 AS (SELECT factor, date, corr(a, b) AS ic FROM mk0 GROUP BY 1, 2 HAVING count(*) >= 5), MI AS (SELECT factor, date, ic FROM mi0 WHERE isfinite(ic)),
ST0 AS (SELECT factor, abs(CASE WHEN stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) ELSE 0 END) AS strength FROM (SELECT factor, greatest(least(ic, 0.3), -0.3) AS x FROM MI) GROUP BY factor)"""
#: For queries that read coefficients only, in whose SQL correlations of values stand unread.
MANY_IC_SQL = _many_sql(" AND date_diff('day', DATE '1990-01-01', date) % 28 = 0") + _IC_SQL
WHOLE_IC_SQL = MANY_SQL + _IC_SQL


def _greedy(links: str, name: str, ranked: str) -> str:
    """SQL: the names of a table (factor, strength) in order of strength that have no link with one taken before."""
    return f""", {name}_n AS (SELECT factor, list(other) AS near FROM (SELECT factor, other FROM {links} UNION ALL SELECT other, factor FROM {links}) GROUP BY factor),
{name}_o AS (SELECT r.factor, coalesce(near, []) AS near, row_number() OVER (ORDER BY strength DESC, r.factor) AS place FROM {ranked} r LEFT JOIN {name}_n n ON n.factor = r.factor),
{name}_k AS (SELECT 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL SELECT place, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, factor) END FROM {name}_k JOIN {name}_o ON place = i + 1),
{name} AS (SELECT unnest(kept) AS factor, generate_subscripts(kept, 1)::INTEGER AS place FROM (SELECT kept FROM {name}_k ORDER BY i DESC LIMIT 1))"""


RECURSIVE = "WITH RECURSIVE " + PANEL_SQL.strip()


@query(RECURSIVE + WHOLE_IC_SQL + ", lk AS (SELECT factor, other FROM PSM WHERE mean_abs > 0.4)" + _greedy("lk", "chosen", "ST0") + " SELECT factor, place FROM chosen")
def value_dedup(spark, folder):
    """Greedy choice by strength among factors whose values correlate."""
    panel = stored_panel(spark, folder)
    stats = ic.ic_stats(many_ics(panel), "factor")
    return selection.without_redundant(stats, pools.summarised(value_correlations(panel)).select("factor", "other", c("mean_abs").alias("corr")), 0.4)


@query(RECURSIVE + WHOLE_IC_SQL + """, ip AS (SELECT a.factor, b.factor AS other FROM MI a JOIN MI b ON a.date = b.date AND a.factor < b.factor GROUP BY 1, 2 HAVING count(*) >= 10 AND abs(corr(a.ic, b.ic)) > 0.5)"""
+ _greedy("ip", "one", "ST0") + ", st1 AS (SELECT ST0.factor, strength FROM ST0 JOIN one ON one.factor = ST0.factor), lk AS (SELECT factor, other FROM PSM WHERE mean_abs > 0.4)" + _greedy("lk", "two", "st1") + " SELECT factor, place FROM two")
def dual_dedup(spark, folder):
    """First by the coefficients' correlation, then, among what is left, by the values'."""
    panel = stored_panel(spark, folder)
    series = many_ics(panel)
    stats = ic.ic_stats(series, "factor")
    first = selection.without_redundant(stats, selection.ic_correlations(series), 0.5)
    links = pools.summarised(value_correlations(panel)).select("factor", "other", c("mean_abs").alias("corr"))
    return selection.without_redundant(stats.join(first.select("factor"), "factor"), links, 0.4)


_D = "(SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT date FROM MI GROUP BY date HAVING count(DISTINCT factor) >= ceil(0.5 * (SELECT count(DISTINCT factor) FROM MI)))) WHERE k > 26)"


@query(MANY_IC_SQL + f", rd AS {_D}, o AS (SELECT rd.date, m.factor, m.ic, row_number() OVER (PARTITION BY rd.date, m.factor ORDER BY m.date DESC) AS back FROM rd JOIN MI m ON m.date < rd.date), w AS (SELECT date, factor, count(*) AS n, avg(ic) AS mean, stddev_pop(ic) AS s FROM o WHERE back <= 26 GROUP BY 1, 2) SELECT f.factor, rd.date, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(mean / CASE WHEN s > 1e-12 THEN s END, 5) AS icir FROM rd CROSS JOIN (SELECT DISTINCT factor FROM MI) f LEFT JOIN w ON w.date = rd.date AND w.factor = f.factor")
def pool_statistics(spark, folder):
    """Of the 26 last coefficients strictly before each rebalance date."""
    series = many_ics(stored_panel(spark, folder))
    out = pools.rolling_window_stats(series, pools.rebalance_dates(series, window=26), 26)
    return out.select("factor", "date", "n", F.round("mean", 6).alias("mean"), F.round("icir", 5).alias("icir"))


@query(MANY_IC_SQL + f", rd AS {_D}, nd AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM MI)), q AS (SELECT r.date, a.factor, b.factor AS other, corr(a.ic, b.ic) AS corr, stddev_pop(a.ic) * stddev_pop(b.ic) AS s FROM rd JOIN nd r ON r.date = rd.date JOIN nd p ON p.k < r.k AND p.k >= r.k - 26 JOIN MI a ON a.date = p.date JOIN MI b ON b.date = p.date AND a.factor < b.factor GROUP BY 1, 2, 3) SELECT date, factor, other, round(corr, 6) AS corr FROM q WHERE s > 1e-18 AND abs(corr) > 0.5")
def coefficient_links(spark, folder):
    """Pairs whose coefficients of the 26 dates before a rebalance date correlate by more than a half."""
    series = many_ics(stored_panel(spark, folder))
    return rounded(pools.series_links(series, pools.rebalance_dates(series, window=26), 26, 0.5))


@query()
def pool_rotation(spark, folder):
    """A pool of at most five of eight factors that changes with every date, a fifth of it at least; leavers stay out for one date."""
    panel = stored_panel(spark, folder)
    series = many_ics(panel)
    dates = pools.rebalance_dates(series, window=26)
    stats = pools.rolling_window_stats(series, dates, 26).withColumn("schedule", F.lit("all"))
    # Values are compared in every fourth week's section, of which the last 26 make two years.
    sections = F.datediff("date", F.lit("1990-01-01").cast("date")) % 28 == 0
    passes = selection.passes_gate(c("mean"), c("icir"), c("n"), 0.015, 0.1, 26)
    out = pools.pool_schedule(stats, passes, pools.series_links(series, dates, 26, 0.7), pools.value_links(value_correlations(panel, sections), dates, 26, 0.7), k_max=5, turnover=0.2, cooldown=1)
    return rounded(out)


@query(RECURSIVE + MANY_IC_SQL + ", f3 AS (SELECT factor, strength FROM ST0 WHERE factor IN ('reversal', 'size', 'range')), p3 AS (SELECT a.factor, b.factor AS other FROM MI a JOIN MI b ON a.date = b.date AND a.factor < b.factor GROUP BY 1, 2 HAVING count(*) >= 10 AND abs(corr(a.ic, b.ic)) > 0.3)" + _greedy("p3", "chosen", "f3") + " SELECT factor, place FROM chosen")
def greedy_choice(spark, folder):
    """Of three factors, by falling strength, those whose coefficients don't correlate with one's kept before."""
    series = factor_ics(spark, folder)
    return selection.without_redundant(ic.ic_stats(series, "factor"), selection.ic_correlations(series), 0.3)


@query()
def gram_schmidt_selection(spark, folder):
    """Of eight factors those that add something to the ones chosen before, tried by strength."""
    panel = stored_panel(spark, folder)
    rows = many_factors(panel)
    stats = ic.ic_stats(many_ics(panel), "factor")
    return rounded(choice.gram_schmidt_selection(rows, stats, 5, first_ic=0.0, first_icir=0.0, first_t=0.0, least=5))


_CL_SQL = SCORE_SQL + ", cw AS (SELECT date, code, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _MANY.items()) + " FROM S)"


@query(_CL_SQL + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END, 0), 6) AS corr FROM cw" for i, a in enumerate(sorted(_MANY)) for b in sorted(_MANY)[i + 1 :]))
def feature_correlations(spark, folder):
    """Correlation of every two features over all rows, in one pass."""
    wide = scored(spark, folder).select("date", "code", *(F.expr(e).cast("double").alias(n) for n, e in _MANY.items()))
    return rounded(choice.feature_correlations(wide, sorted(_MANY)))


@query()
def cluster_importance(spark, folder):
    """What a linear score of eight standardised features loses without each group of features that move together."""
    wide = scored(spark, folder).select("date", "code", "fwd", *(F.expr(e).cast("double").alias(n) for n, e in _MANY.items()))
    wide = wide.select("date", "code", "fwd", *(cs.cs_zscore(c(n)).alias(n) for n in sorted(_MANY)))
    # Read twice: for the groups and for their importance.
    wide = written(wide, "features")
    clusters = choice.clustered_features(wide, sorted(_MANY), 0.7)
    return rounded(choice.cluster_importance(wide, {n: 0.1 * (k + 1) for k, n in enumerate(sorted(_MANY))}, clusters, "fwd", 5, 42, 5))
