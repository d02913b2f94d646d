"""Queries of folds, sample weights, model combination, overfitting tests, regimes and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import crosssection as cs
from .functions import timeseries as ts
from .model_queries import _TAIL, ROWS_SQL, factor_ics
from .operators import scoring, training
from .queries import CODE, RET_SQL, SCORE_SQL, c, frame_sql, query, ret_panel, rounded, scored
from .sources.panel import weekly_panel

MONTHS = ", M AS (SELECT max(date) AS date FROM P GROUP BY date_trunc('month', date))"


def months(spark, folder):
    return weekly_panel(spark, folder).groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")


@query(MONTHS + ", k AS (SELECT date, row_number() OVER w AS k, lag(date, 6) OVER w AS vf, lag(date, 1) OVER w AS vt, lag(date, 30) OVER w AS tf, lag(date, 9) OVER w AS tt FROM M WINDOW w AS (ORDER BY date)) SELECT date, tf AS train_from, tt AS train_to, vf AS validation_from, vt AS validation_to, (k - 24 - 6 - 1) % 3 = 0 AS retrains FROM k WHERE tf IS NOT NULL")
def walk_forward_folds(spark, folder):
    return training.folds(months(spark, folder), 24, 6, embargo=1, hold=2, every=3)


@query(MONTHS + ", g AS (SELECT date - lag(date) OVER (ORDER BY date) AS gap, row_number() OVER (ORDER BY date) AS k FROM M) SELECT CAST(greatest(1, ceil(45 / quantile_cont(gap, 0.5))) AS INTEGER) AS periods FROM g WHERE k <= 20")
def embargo_width(spark, folder):
    return training.embargo_periods(45, months(spark, folder))


@query(MONTHS + ", o AS (SELECT date, date + 1 AS a, date + 40 AS b, coalesce(lead(date) OVER (ORDER BY date), (SELECT max(date) FROM P) + 21) AS nx FROM M) SELECT date, round(greatest(0.1, 1 - 0.5 * greatest(0, least(b, nx + 40) - greatest(a, nx + 1) + 1) / 40), 6) AS weight FROM o")
def overlap_weights(spark, folder):
    """Labels of 40 days; the date to predict is 21 days after the last."""
    last = weekly_panel(spark, folder).agg(F.max("date").alias("last"))
    dates = months(spark, folder).crossJoin(F.broadcast(last))  # one row
    weights = training.overlap_weights(dates, 40, F.date_add("last", 21))
    return rounded(weights)


@query(SCORE_SQL + ", k AS (SELECT code, date, volume FROM S WHERE fwd IS NOT NULL), n AS (SELECT date, count(*) AS n FROM k GROUP BY date) SELECT code, k.date, round(volume * n / (SELECT max(n) FROM n), 6) AS weight FROM k JOIN n ON n.date = k.date")
def universe_weights(spark, folder):
    rows = scored(spark, folder).where("fwd is not null").select("code", "date", c("volume").alias("weight"))
    return rounded(training.universe_weights(rows, "weight"))


@query(SCORE_SQL + " SELECT code, date, CAST(CASE WHEN fwd IS NOT NULL THEN row_number() OVER (PARTITION BY date, fwd IS NULL ORDER BY fwd, code) - 1 END AS INTEGER) AS relevance FROM S")
def rank_labels(spark, folder):
    return scored(spark, folder).select("code", "date", training.rank_labels("fwd").alias("relevance"))


@query(SCORE_SQL + " SELECT code, date, round(fwd / (SELECT stddev_pop(fwd) FROM S), 6) AS fwd FROM S")
def variance_align(spark, folder):
    return rounded(training.variance_aligned(scored(spark, folder).select("code", "date", "fwd"), "fwd"))


@query(SCORE_SQL + """, r AS (SELECT *, CASE WHEN score IS NOT NULL THEN (rank() OVER (PARTITION BY date, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(score) OVER (PARTITION BY date) END AS pr FROM S), ins AS (SELECT code, date, CASE WHEN coalesce(pr >= 0.6, false) THEN fwd END AS v FROM r),
w AS (SELECT *, count(v) OVER d AS n, quantile_cont(v, 0.01) OVER d AS lo, quantile_cont(v, 0.99) OVER d AS hi FROM ins WINDOW d AS (PARTITION BY date)), b AS (SELECT *, CASE WHEN n >= 3 AND v IS NOT NULL THEN least(greatest(v, lo), hi) ELSE v END AS cv FROM w), z AS (SELECT *, count(cv) OVER (PARTITION BY date) AS k, avg(cv) OVER (PARTITION BY date) AS m, stddev_pop(cv) OVER (PARTITION BY date) AS sd FROM b)
SELECT code, date, round(CASE WHEN cv IS NOT NULL THEN CASE WHEN k >= 2 AND sd > 1e-12 THEN (cv - m) / sd ELSE 0 END END, 6) AS z FROM z""")
def pool_standardise(spark, folder):
    panel = scored(spark, folder).withColumn("pr", cs.cs_rank(c("score")))
    return rounded(training.pool_standardised(panel, "fwd", c("pr") >= 0.6).select("code", "date", "z"))


FI = ROWS_SQL


@query(FI + ", iv AS (SELECT factor, date, coalesce(ic, 0) AS v FROM FI), iw AS (SELECT *, sum(CASE WHEN v > 1e-12 THEN v ELSE 0 END) OVER (PARTITION BY date) AS t, exp((v - max(v) OVER (PARTITION BY date)) / 0.5) AS e FROM iv) SELECT factor, date, round(CASE WHEN t > 0 THEN CASE WHEN v > 1e-12 THEN v ELSE 0 END / t ELSE e / sum(e) OVER (PARTITION BY date) END, 6) AS weight FROM iw")
def ic_weighted_weights(spark, folder):
    return rounded(factor_ics(spark, folder).select("factor", "date", training.positive_weights(c("ic"), "date").alias("weight")))


@query(FI + ", m AS (SELECT factor, date, coalesce(avg(ic) OVER (PARTITION BY factor ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS m FROM FI), e AS (SELECT *, exp((m - max(m) OVER (PARTITION BY date)) / 0.5) AS e FROM m) SELECT factor, date, round(e / sum(e) OVER (PARTITION BY date), 6) AS weight FROM e")
def model_weights(spark, folder):
    return rounded(training.softmax_of_recent(factor_ics(spark, folder)))


_Z = "({x} - avg({x}) OVER (PARTITION BY date)) / CASE WHEN stddev_pop({x}) OVER (PARTITION BY date) > 1e-12 THEN stddev_pop({x}) OVER (PARTITION BY date) END"


@query(SCORE_SQL + f", y AS (SELECT code, date, score, -amount AS size FROM S), z AS (SELECT code, date, {_Z.format(x='score')} AS a, {_Z.format(x='size')} AS b FROM y) SELECT code, date, round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (coalesce(a * 0.7, 0) + coalesce(b * 0.3, 0)) / (CASE WHEN a IS NOT NULL THEN 0.7 ELSE 0 END + CASE WHEN b IS NOT NULL THEN 0.3 ELSE 0 END) END, 6) AS score FROM z")
def combined_scores(spark, folder):
    panel = scored(spark, folder).select("code", "date", "score", (-c("amount")).alias("size"))
    return rounded(training.combined(panel.withColumnRenamed("score", "reversal"), {"reversal": 0.7, "size": 0.3}).select("code", "date", "score"))


@query(FI + ", h AS (SELECT factor, date, ic, count(ic) OVER w AS n, avg(ic) OVER w AS m, stddev_pop(ic) OVER w AS s FROM FI WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), z AS (SELECT factor, date, CASE WHEN n >= 5 AND s > 1e-12 THEN (ic - m) / s END AS z FROM h) SELECT factor, date, round(z, 6) AS drift_z, coalesce(abs(z) > 3, false) AS flagged FROM z")
def drift_flags(spark, folder):
    return rounded(training.drift(factor_ics(spark, folder)))


TRIAL_SQL = RET_SQL + ", t AS (SELECT code AS strategy, year(date) AS trial, avg(ret) FILTER (month(date) % 2 = 1) / nullif(stddev_samp(ret) FILTER (month(date) % 2 = 1), 0) AS ins, avg(ret) FILTER (month(date) % 2 = 0) / nullif(stddev_samp(ret) FILTER (month(date) % 2 = 0), 0) AS oos FROM R GROUP BY 1, 2)"


TRIALS_CHOSEN_SQL = TRIAL_SQL + ", k AS (SELECT *, count(*) OVER (PARTITION BY trial) AS n, count(CASE WHEN ins IS NOT NULL AND oos IS NOT NULL THEN 1 END) OVER (PARTITION BY trial) AS known, row_number() OVER (PARTITION BY trial ORDER BY oos NULLS LAST, strategy) AS r FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY CASE WHEN ins IS NOT NULL AND oos IS NOT NULL THEN ins END DESC NULLS LAST, strategy) AS best FROM k WHERE known >= 2), ch AS (SELECT trial, strategy, r / (n + 1) AS relative_rank, r / (n + 1) <= 0.5 AS overfit FROM b WHERE best = 1)"


def _trials(spark, folder):
    odd = F.month("date") % 2 == 1
    ratio = lambda side: F.avg(F.when(side, c("ret"))) / F.when(F.stddev_samp(F.when(side, c("ret"))) != 0, F.stddev_samp(F.when(side, c("ret"))))
    trials = ret_panel(spark, folder).groupBy(c("code").alias("strategy"), F.year("date").cast("long").alias("trial")).agg(ratio(odd).alias("inside"), ratio(~odd).alias("outside"))
    return training.overfitting(trials)


@query(TRIALS_CHOSEN_SQL + " SELECT trial, strategy, round(relative_rank, 6) AS relative_rank, overfit FROM ch")
def backtest_overfitting(spark, folder):
    """Each code is a strategy, each year a trial: odd months inside, even months outside."""
    return rounded(_trials(spark, folder))


@query(TRIALS_CHOSEN_SQL + ", q AS (SELECT count(*) AS trials, avg(CASE WHEN overfit THEN 1.0 ELSE 0.0 END) AS pbo FROM ch) SELECT trials, round(pbo, 6) AS pbo, round(ln(least(greatest(pbo, 1e-6), 1 - 1e-6) / (1 - least(greatest(pbo, 1e-6), 1 - 1e-6))), 6) AS logit_pbo FROM q")
def overfitting_probability(spark, folder):
    return rounded(training.overfitting_probability(_trials(spark, folder)))


@query(RET_SQL + """, m AS (SELECT code, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp FROM R GROUP BY code), mm AS (SELECT R.code, m.n, mu / sd AS sr, avg(pow((ret - mu) / sp, 3)) AS skew, avg(pow((ret - mu) / sp, 4)) AS kurt FROM R JOIN m ON m.code = R.code WHERE ret IS NOT NULL AND sp > 1e-12 GROUP BY R.code, m.n, mu, sd)
, dz AS (SELECT code, n, sr, (sr - greatest(0.01, sqrt(2 * ln(20) / (n - 1)) * (1 - 0.5772156649015329 / (2 * ln(20))))) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)) AS zs FROM mm WHERE n >= 2), dk AS (SELECT *, abs(zs) AS z, 1 / (1 + 0.2316419 * abs(zs)) AS k FROM dz)
SELECT code, n, round(sr, 6) AS sharpe, round(zs, 5) AS deflated_z, round(CASE WHEN zs >= 0 THEN 1 - """ + _TAIL + """ ELSE """ + _TAIL + """ END, 5) AS deflated_sharpe FROM dk""")
def deflated_sharpe(spark, folder):
    """The chance that each code's Sharpe ratio is above both 0.01 a week and the best to expect of 20 tries, and its z."""
    rows = ret_panel(spark, folder).where("ret is not null").groupBy("code").agg(F.count("ret").alias("n"), F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt")).where("n >= 2 and sd > 1e-12")
    sr = c("mu") / c("sd")
    z = (sr - F.greatest(F.lit(0.01), training.deflated_benchmark(20, c("n")))) * F.sqrt(c("n") - 1) / F.sqrt(F.greatest(F.lit(1e-12), 1 - c("skew") * sr + (c("kurt") - 1) / 4 * sr * sr))
    return rows.select("code", "n", F.round(sr, 6).alias("sharpe"), F.round(z, 5).alias("deflated_z"), F.round(scoring.normal_cdf(z), 5).alias("deflated_sharpe"))


STATE_SQL = """, ix AS (SELECT date, sum(amount) / sum(volume) AS px FROM P GROUP BY date), ma AS (SELECT date, px, CASE WHEN count(px) OVER (ORDER BY date ROWS 19 PRECEDING) >= 20 THEN avg(px) OVER (ORDER BY date ROWS 19 PRECEDING) END AS slow FROM ix),
ST AS (SELECT date, px, CASE WHEN coalesce(px > slow * 1.01::DOUBLE, false) THEN 'up' WHEN coalesce(px < slow * 0.99::DOUBLE, false) THEN 'down' ELSE 'flat' END AS state FROM ma)"""


def states(spark, folder):
    index = weekly_panel(spark, folder).groupBy("date").agg((F.sum("amount") / F.sum("volume")).alias("px")).withColumn("code", F.lit("index"))
    slow = ts.ts_mean(c("px"), 20, 20)
    return index.withColumn("slow", slow).select("date", "px", F.when(F.coalesce(c("px") > c("slow") * 1.01, F.lit(False)), "up").when(F.coalesce(c("px") < c("slow") * 0.99, F.lit(False)), "down").otherwise("flat").alias("state"))


@query(FI + STATE_SQL + ", k AS (SELECT factor, state, ic FROM FI JOIN ST ON ST.date = FI.date WHERE ic IS NOT NULL) SELECT factor, state, count(*) AS n, round(avg(ic), 6) AS mean, round(avg(ic) / CASE WHEN stddev_samp(ic) > 1e-12 THEN stddev_samp(ic) END, 5) AS icir, round(avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0 END), 6) AS hits FROM k GROUP BY 1, 2")
def ic_by_state(spark, folder):
    rows = factor_ics(spark, folder).where("ic is not null").join(F.broadcast(states(spark, folder)), "date")  # one row for each date
    return rows.groupBy("factor", "state").agg(F.count("*").alias("n"), F.round(F.avg("ic"), 6).alias("mean"), F.round(F.avg("ic") / F.when(F.stddev_samp("ic") > 1e-12, F.stddev_samp("ic")), 5).alias("icir"), F.round(F.avg((c("ic") > 1e-12).cast("double")), 6).alias("hits"))


@query(STATE_SQL + " SELECT year(date) AS year, " + ", ".join(f"round(100.0 * count(*) FILTER (state = '{s}') / count(*), 4) AS {s}" for s in ("up", "down", "flat")) + " FROM ST GROUP BY 1")
def regime_share(spark, folder):
    share = lambda s: F.round(100.0 * F.count_if(c("state") == s) / F.count("*"), 4).alias(s)
    return states(spark, folder).groupBy(F.year("date").cast("long").alias("year")).agg(share("up"), share("down"), share("flat"))


@query(STATE_SQL + " SELECT CAST(date_trunc('month', date) AS DATE) AS month, arg_max(state, date) AS state FROM ST GROUP BY 1")
def dominant_regime(spark, folder):
    return states(spark, folder).groupBy(F.trunc("date", "month").alias("month")).agg(F.max_by("state", "date").alias("state"))


@query(STATE_SQL + ", b AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (ORDER BY date) THEN 1 ELSE 0 END AS new FROM ST), g AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM b) SELECT CAST(run AS BIGINT) AS run, any_value(state) AS state, min(date) AS first, max(date) AS last, count(*) AS n, round(arg_max(px, date) / arg_min(px, date) - 1, 6) AS change FROM g GROUP BY run")
def regime_stretches(spark, folder):
    """Runs of one state; the index has one row for each date."""
    at = Window.orderBy("date")
    new = F.when(c("state").eqNullSafe(F.lag("state").over(at)), 0).otherwise(1)
    runs = states(spark, folder).withColumn("new", new).withColumn("run", F.sum("new").over(at))
    return runs.groupBy("run").agg(F.first("state").alias("state"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.round(F.max_by("px", "date") / F.min_by("px", "date") - 1, 6).alias("change"))


@query(RET_SQL + ", ix AS (SELECT date, avg(ret) AS market FROM R GROUP BY date) SELECT code, R.date, round(market, 9) AS market, round(ret - market, 6) AS excess FROM R JOIN ix ON ix.date = R.date")
def benchmark_excess(spark, folder):
    panel = ret_panel(spark, folder)
    market = panel.groupBy("date").agg(F.avg("ret").alias("market"))  # one row for each date
    return panel.join(F.broadcast(market), "date").select("code", "date", F.round("market", 9).alias("market"), F.round(c("ret") - c("market"), 6).alias("excess"))


@query(RET_SQL + f", ix AS (SELECT date, avg(ret) AS market FROM R GROUP BY date), y AS (SELECT code, R.date, ret, CASE WHEN ret IS NOT NULL THEN market END AS market FROM R JOIN ix ON ix.date = R.date) SELECT code, date, round(CASE WHEN count(CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END) {frame_sql(26)} >= 13 AND stddev_pop(market) {frame_sql(26)} > 1e-12 THEN covar_samp(ret, market) {frame_sql(26)} / var_samp(market) {frame_sql(26)} END, 5) AS beta FROM y")
def market_beta(spark, folder):
    """Trailing regression on the equal-weighted market."""
    panel = ret_panel(spark, folder)
    market = panel.groupBy("date").agg(F.avg("ret").alias("market"))
    both = panel.join(F.broadcast(market), "date").withColumn("market", F.when(c("ret").isNotNull(), c("market")))
    over = ts.frame(26)
    enough = (F.count(F.when(c("ret").isNotNull() & c("market").isNotNull(), 1)).over(over) >= 13) & (F.stddev_pop("market").over(over) > 1e-12)
    slope = F.when(enough, F.covar_samp("ret", "market").over(over) / F.when(F.var_samp("market").over(over) > 0, F.var_samp("market").over(over)))
    return rounded(both.select("code", "date", slope.alias("beta")), 5)


_FFD = [1.0]
for _k in range(1, 10):
    _FFD.append(-_FFD[-1] * (0.4 - _k + 1) / _k)


@query(" SELECT code, date, round(" + " + ".join(f"({w!r}::DOUBLE) * ln(lag(close, {k}) {CODE})" for k, w in enumerate(_FFD)) + ", 6) AS x FROM P")
def fractional_difference(spark, folder):
    """Fixed-width fractional difference of order 0.4 of the log close: null where any of the ten rows is."""
    from functools import reduce

    terms = [F.ln(ts.delay(c("close"), k)) * F.lit(w) for k, w in enumerate(_FFD)]
    return rounded(weekly_panel(spark, folder).select("code", "date", reduce(lambda a, b: a + b, terms).alias("x")))


_HALF = [0.5 ** (k / 4) for k in range(13)]


@query(RET_SQL + ", l AS (SELECT code, date, " + ", ".join(f"lag(ret, {k}) {CODE} AS x{k}" for k in range(13)) + " FROM R) SELECT code, date, round((" + " + ".join(f"coalesce(x{k} * {w!r}::DOUBLE, 0)" for k, w in enumerate(_HALF)) + ") / nullif(" + " + ".join(f"CASE WHEN x{k} IS NOT NULL THEN {w!r}::DOUBLE ELSE 0 END" for k, w in enumerate(_HALF)) + ", 0), 6) AS mean FROM l")
def halflife_mean(spark, folder):
    """Mean of the last 13 changes with weights that halve every four rows; nulls are left out."""
    from functools import reduce

    panel = ret_panel(spark, folder).withColumns({f"x{k}": ts.delay(c("ret"), k) for k in range(13)})
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    total = add([F.when(c(f"x{k}").isNotNull(), F.lit(w)).otherwise(0.0) for k, w in enumerate(_HALF)])
    return rounded(panel.select("code", "date", (add([F.coalesce(c(f"x{k}") * w, F.lit(0.0)) for k, w in enumerate(_HALF)]) / F.when(total > 0, total)).alias("mean")))


@query(", d AS (SELECT DISTINCT date FROM P) SELECT date, lead(date, 1) OVER (ORDER BY date) AS next_session, lead(date, 2) OVER (ORDER BY date) AS execution, lead(date, 6) OVER (ORDER BY date) AS exit, coalesce(max(CASE WHEN day(date) <= 7 THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), NULL) AS month_floor FROM d")
def session_calendar(spark, folder):
    """Next session, execution two sessions on, exit after four more, and the last first-week session up to each date."""
    at = Window.orderBy("date")  # one row for each date
    days = weekly_panel(spark, folder).select("date").distinct()
    floor = F.last(F.when(F.dayofmonth("date") <= 7, c("date")), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0))
    return days.select("date", F.lead("date", 1).over(at).alias("next_session"), F.lead("date", 2).over(at).alias("execution"), F.lead("date", 6).over(at).alias("exit"), floor.alias("month_floor"))
