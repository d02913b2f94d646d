"""Queries of walk-forward training under a pool, by market state and in two stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import crosssection as cs
from .operators import pools, walk_forward
from .pool_queries import _D, _MANY, MANY_IC_SQL, many_factors, many_ics, stored_panel
from .queries import c, query, rounded, scored
from .training_queries import STATE_SQL, states

_NAMES = sorted(_MANY)


def _decisions(panel):
    """Every thirteenth rebalance date the three factors with the largest mean of their last 26 coefficients."""
    series = many_ics(panel)
    dates = pools.rebalance_dates(series, window=26)
    some = dates.withColumn("k", F.row_number().over(Window.orderBy("date"))).where("k % 13 = 1").select("date")  # one row for each date
    stats = pools.rolling_window_stats(series, some, 26).where("mean is not null")
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round(F.abs("mean"), 12)), "factor"))
    return stats.withColumn("place", place).where("place <= 3").select("date", "factor")


DECISIONS_SQL = MANY_IC_SQL + f""", rd AS {_D}, rn AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM rd) WHERE k % 13 = 1), ob AS (SELECT rn.date, m.factor, m.ic, row_number() OVER (PARTITION BY rn.date, m.factor ORDER BY m.date DESC) AS back FROM rn JOIN MI m ON m.date < rn.date),
wm AS (SELECT date, factor, avg(ic) AS mean FROM ob WHERE back <= 26 GROUP BY 1, 2), DC AS (SELECT date, factor FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(abs(mean), 12) DESC, factor) AS place FROM wm) WHERE place <= 3),
lat AS (SELECT d.date, max(DC.date) AS at FROM (SELECT DISTINCT date FROM FM) d JOIN DC ON DC.date <= d.date GROUP BY 1)"""


@query(DECISIONS_SQL + ", kf AS (SELECT FM.date, FM.code, FM.factor, FM.x FROM FM JOIN lat ON lat.date = FM.date JOIN DC ON DC.date = lat.at AND DC.factor = FM.factor) SELECT date, code, " + ", ".join(f"round(max(x) FILTER (factor = '{n}'), 6) AS {n}" for n in _NAMES) + " FROM kf GROUP BY date, code")
def pool_feature_table(spark, folder):
    """Features of the pool in force, null for those outside it."""
    panel = stored_panel(spark, folder)
    rows = many_factors(panel).select("factor", "date", "code", "x")
    return rounded(walk_forward.feature_table(rows, _decisions(panel), _NAMES))


@query(STATE_SQL + """, sk AS (SELECT date, state, row_number() OVER (ORDER BY date) AS k FROM ST), sp AS (SELECT a.date, b.date AS train, a.state = b.state AS own FROM sk a JOIN sk b ON b.k < a.k - 2 AND b.k >= a.k - 54), sc AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, count(*) FILTER (own) OVER (PARTITION BY date) AS same FROM sp)
SELECT date, train FROM sc WHERE n >= 12 AND (same < 12 OR own)""")
def state_training_dates(spark, folder):
    """Of the 52 dates up to three before each date those of its own market state, or all where these are fewer than twelve."""
    return walk_forward.training_dates(states(spark, folder).select("date", "state"), 52, 2, "state", 12)


def _features(spark, folder):
    wide = scored(spark, folder).select("date", "code", "score", "fwd", *(F.expr(e).cast("double").alias(n) for n, e in _MANY.items()))
    return wide.select("date", "code", "score", "fwd", *(cs.cs_zscore(c(n)).alias(n) for n in _NAMES))


@query()
def regime_ridge_scores(spark, folder):
    """Ridge scores trained on dates of the market's own state."""
    return rounded(walk_forward.ridge_scores(_features(spark, folder), _NAMES, "fwd", state_training_dates(spark, folder), 1.0, 100))


@query()
def two_stage_scores(spark, folder):
    """A second ridge within the best third by the first score."""
    out = walk_forward.two_stage(_features(spark, folder), "score", _NAMES, "fwd", 52, 2, 1 / 3, 60, 2)
    return rounded(out.withColumn("score", F.when(c("in_pool"), c("score"))))
