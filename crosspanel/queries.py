"""The queries on the supplier panel and their SQL, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import crosssection as cs
from .functions import scalars
from .functions import timeseries as ts
from .operators import asof, calendar, clean, ic, labels, neutralize, portfolio
from .plans import series
from .sources.panel import PANEL_SQL, on_grid, table, weekly_panel, with_industry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Registers a query under its function's name; sql follows the panel's common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = "WITH " + PANEL_SQL.strip() + sql if sql.lstrip().startswith((",", "SELECT")) else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def frame_sql(w: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


CODE = "OVER (PARTITION BY code ORDER BY date)"
RET_SQL = f", R AS (SELECT *, close / lag(close) {CODE} - 1 AS ret FROM P)"


def ret_panel(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_panel(spark, folder).withColumn("ret", c("close") / ts.delay(c("close"), 1) - 1)


def guard_sql(expr: str, w: int, least: int, counted: str) -> str:
    return f"CASE WHEN count({counted}) {frame_sql(w)} >= {least} THEN {expr} {frame_sql(w)} END"


@query(" SELECT code, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, amount FROM P")
def panel_weekly(spark, folder):
    return rounded(weekly_panel(spark, folder))


@query(f""", a AS (SELECT code, date, close / last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS ch, close FROM P),
b AS (SELECT code, date, CASE WHEN abs(ch) <= 1 THEN close END AS close FROM a),
d AS (SELECT code, date, close, close / ((lag(close) {CODE} + lead(close) {CODE}) / 2) AS s FROM b)
SELECT code, date, round(CASE WHEN NOT coalesce(s > 3 OR s < 1.0 / 3, false) THEN close END, 6) AS close FROM d""")
def clean_prices(spark, folder):
    return rounded(clean.clean_prices(weekly_panel(spark, folder), ["close"]).select("code", "date", "close"))


LIMIT_SQL = f""", m AS (SELECT *, close / lag(close) {CODE} - 1 AS ch FROM P),
f AS (SELECT *, coalesce(close = high AND ch >= 0.095 * 0.98, false) AS limit_up, coalesce(close = low AND ch <= -0.095 * 0.98, false) AS limit_down FROM m),
L AS (SELECT *, limit_up OR limit_down AS any_limit, limit_up AND coalesce(open = close, false) AS limit_up_open, limit_down AND coalesce(open = close, false) AS limit_down_open,
  coalesce(lag(limit_up) {CODE}, false) AND NOT limit_up AS broke_limit FROM f)"""


@query(LIMIT_SQL + " SELECT code, date, limit_up, limit_down, any_limit, limit_up_open, limit_down_open, broke_limit FROM L")
def limit_masks(spark, folder):
    return clean.limit_flags(weekly_panel(spark, folder)).select("code", "date", "limit_up", "limit_down", "any_limit", "limit_up_open", "limit_down_open", "broke_limit")


@query(LIMIT_SQL + " SELECT code, date, round(CASE WHEN NOT any_limit THEN ch END, 6) AS ret FROM L")
def clean_return(spark, folder):
    return rounded(clean.clean_return(weekly_panel(spark, folder)).select("code", "date", "ret"))


@query(LIMIT_SQL + """, g AS (SELECT *, min(CASE WHEN close IS NOT NULL THEN date END) OVER (PARTITION BY code) AS first FROM L)
SELECT code, date, coalesce(volume > 0, false) AND close IS NOT NULL AND coalesce(date_diff('day', first, date) >= 60, false) AND NOT limit_up AS can_buy,
  coalesce(volume > 0, false) AND close IS NOT NULL AND NOT limit_down AS can_sell FROM g""")
def tradable_mask(spark, folder):
    return clean.tradable(clean.limit_flags(weekly_panel(spark, folder))).select("code", "date", "can_buy", "can_sell")


@query(", d AS (SELECT date, quantile_cont(amount / CASE WHEN volume * close > 0 THEN volume * close END, 0.5) AS m FROM P GROUP BY date) SELECT round(quantile_cont(m, 0.5), 6) AS ratio, quantile_cont(m, 0.5) BETWEEN 0.5 AND 2.0 AS valid FROM d")
def amount_units(spark, folder):
    return rounded(clean.unit_ratio(weekly_panel(spark, folder)))


@query(""", n AS (SELECT date, count(close) AS n FROM P GROUP BY date), k AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM n),
t AS (SELECT quantile_cont(n, 0.5) AS m FROM k WHERE k BETWEEN 11 AND 50), l AS (SELECT max(date) AS last FROM n, t WHERE n >= 0.5 * m)
SELECT date, count(close) AS n FROM P, l WHERE date <= last GROUP BY date""")
def sparse_tail(spark, folder):
    return clean.sparse_tail_cut(weekly_panel(spark, folder), "close").groupBy("date").agg(F.count("close").alias("n"))


REPORTS_SQL = """, rep AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, last_day(l_shipdate)::DATE AS report_date, round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2),
av AS (SELECT *, CAST(report_date + to_days(CAST(CASE quarter(report_date) WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 30 ELSE 90 END AS INTEGER)) AS DATE) AS available FROM rep)"""


def monthly_reports(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.lpad(c("l_suppkey").cast("string"), 6, "0").alias("code"), F.last_day("l_shipdate").alias("report_date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.sum("l_quantity").alias("units"))


@query(REPORTS_SQL + """, a2 AS (SELECT code, available, avg(revenue) AS revenue, avg(units) AS units FROM av GROUP BY code, available)
SELECT P.code, P.date, round(r.revenue, 4) AS revenue, round(r.units, 4) AS units FROM P ASOF LEFT JOIN a2 r ON P.code = r.code AND P.date >= r.available""")
def pit_asof(spark, folder):
    reports = asof.with_available_dates(monthly_reports(spark, folder))
    return rounded(asof.as_of(weekly_panel(spark, folder), reports, ["revenue", "units"]), 4)


SEGMENTS_SQL = """, ch AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(date_trunc('year', l_shipdate) AS DATE) AS effective_date, max(l_returnflag) AS sw_l1, min(l_linestatus || l_returnflag) AS sw_l2 FROM lineitem GROUP BY 1, 2),
seg AS (SELECT *, CAST(lead(effective_date) OVER (PARTITION BY code ORDER BY effective_date) - INTERVAL 1 DAY AS DATE) AS end_date FROM ch)"""


def yearly_segments(spark, folder):
    changes = table(spark, folder, "lineitem").groupBy(F.lpad(c("l_suppkey").cast("string"), 6, "0").alias("code"), F.trunc("l_shipdate", "year").alias("effective_date")).agg(F.max("l_returnflag").alias("sw_l1"), F.min(F.concat("l_linestatus", "l_returnflag")).alias("sw_l2"))
    return asof.segments(changes, ["sw_l1", "sw_l2"])


@query(SEGMENTS_SQL + " SELECT code, effective_date, end_date, sw_l1, sw_l2 FROM seg")
def industry_segments(spark, folder):
    return yearly_segments(spark, folder)


@query(SEGMENTS_SQL + """, hit AS (SELECT P.code, P.date, arg_max(sw_l1, effective_date) AS sw_l1, arg_max(sw_l2, effective_date) AS sw_l2 FROM P JOIN seg ON seg.code = P.code AND effective_date <= date AND (end_date IS NULL OR date <= end_date) GROUP BY 1, 2)
SELECT P.code, P.date, sw_l1, sw_l2 FROM P LEFT JOIN hit ON hit.code = P.code AND hit.date = P.date""")
def scd2_asof(spark, folder):
    return asof.segment_as_of(weekly_panel(spark, folder).select("code", "date"), yearly_segments(spark, folder), ["sw_l1", "sw_l2"])


@query(""", ln AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS start_date, CAST(l_linenumber AS INTEGER) AS weeks FROM lineitem), lm AS (SELECT code, max(start_date) AS last FROM ln GROUP BY code),
iv AS (SELECT ln.code, start_date, max(CASE WHEN start_date < last THEN start_date + 7 * weeks ELSE DATE '9999-12-31' END) AS end_date FROM ln JOIN lm ON lm.code = ln.code GROUP BY 1, 2), hit AS (SELECT DISTINCT P.code, P.date FROM P JOIN iv ON iv.code = P.code AND date BETWEEN start_date AND end_date)
SELECT P.code, P.date, hit.code IS NOT NULL AS flagged FROM P LEFT JOIN hit ON hit.code = P.code AND hit.date = P.date""")
def interval_flag(spark, folder):
    """An interval from every line, of a week for each line number; the code's latest lines are still in force."""
    lines = table(spark, folder, "lineitem").select(F.lpad(c("l_suppkey").cast("string"), 6, "0").alias("code"), c("l_shipdate").cast("date").alias("start_date"), c("l_linenumber").cast("int").alias("weeks"))
    last = lines.groupBy("code").agg(F.max("start_date").alias("last"))
    intervals = lines.join(last, "code").select("code", "start_date", F.when(c("start_date") < c("last"), F.date_add("start_date", 7 * c("weeks"))).alias("end_date"))
    return asof.interval_flag(weekly_panel(spark, folder).select("code", "date"), intervals, "flagged")


@query(""", x AS (SELECT P.*, industry, sector FROM P LEFT JOIN I ON I.code = P.code)
SELECT code, date, round(CASE WHEN count(close) OVER (PARTITION BY date, sector) >= 2 THEN close - avg(close) OVER (PARTITION BY date, sector) ELSE close END, 6) AS demeaned,
 round(CASE WHEN count(close) OVER (PARTITION BY date, sector) >= 5 THEN (sum(close) OVER (PARTITION BY date, sector) - close) / (count(close) OVER (PARTITION BY date, sector) - 1) END, 6) AS others FROM x""")
def industry_demean(spark, folder):
    panel = with_industry(spark, folder, weekly_panel(spark, folder))
    return rounded(panel.select("code", "date", cs.demean(c("close"), "sector").alias("demeaned"), cs.exclude_self_mean(c("close"), "sector").alias("others")))


@query(RET_SQL + ", s AS (SELECT code, date, " + ", ".join(f"{guard_sql(e, 10, n, 'ret')} AS {a}" for a, e, n in (("s", "sum(ret)", 7), ("m", "avg(ret)", 5), ("sd", "stddev_samp(ret)", 5), ("hi", "max(ret)", 7), ("lo", "min(ret)", 7)))
       + f", CASE WHEN count(close) {frame_sql(5)} >= 3 THEN exp(sum(ln(close / 1000)) {frame_sql(5)}) END AS p FROM R) SELECT code, date, round(s, 6) AS s, round(m, 6) AS m, round(sd, 6) AS sd, round(hi, 6) AS hi, round(lo, 6) AS lo, round(p, 6) AS p FROM s")
def ts_basic(spark, folder):
    r = c("ret")
    return rounded(ret_panel(spark, folder).select("code", "date", ts.ts_sum(r, 10).alias("s"), ts.ts_mean(r, 10).alias("m"), ts.ts_std(r, 10).alias("sd"), ts.ts_max(r, 10).alias("hi"), ts.ts_min(r, 10).alias("lo"), ts.ts_prod(c("close") / 1000, 5).alias("p")))


@query(f""", x AS (SELECT code, date, count(CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN 1 END) {frame_sql(12)} AS n, corr(close, volume) {frame_sql(12)} AS r, covar_samp(close, volume) {frame_sql(12)} AS v FROM P)
SELECT code, date, round(CASE WHEN n >= 8 AND isfinite(r) THEN r END, 6) AS corr, round(CASE WHEN n >= 8 THEN v END, 4) AS cov FROM x""")
def ts_corr_cov(spark, folder):
    out = weekly_panel(spark, folder).select("code", "date", ts.ts_corr(c("close"), c("volume"), 12).alias("corr"), ts.ts_cov(c("close"), c("volume"), 12).alias("cov"))
    return out.select("code", "date", F.round("corr", 6).alias("corr"), F.round("cov", 4).alias("cov"))


@query(f""", x AS (SELECT code, date, close, list(close) FILTER (close IS NOT NULL) {frame_sql(10)} AS l FROM P)
SELECT code, date, round(CASE WHEN close IS NOT NULL AND len(l) >= 7 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0) / len(l) END, 6) AS r FROM x""")
def ts_rank(spark, folder):
    return rounded(weekly_panel(spark, folder).select("code", "date", ts.ts_rank(c("close"), 10).alias("r")))


@query(f""", x AS (SELECT code, date, list(close) {frame_sql(8)} AS l FROM P)
SELECT code, date, CASE WHEN len(l) = 8 AND list_max(l) IS NOT NULL THEN CAST(list_position(l, list_max(l)) - 1 AS DOUBLE) END AS argmax, CASE WHEN len(l) = 8 AND list_max(l) IS NOT NULL THEN CAST(list_position(l, list_min(l)) - 1 AS DOUBLE) END AS argmin,
 CASE WHEN len(l) = 8 AND list_max(l) IS NOT NULL THEN CAST(8 - (list_position(l, list_max(l)) - 1) AS DOUBLE) END AS highday, CASE WHEN len(l) = 8 AND list_max(l) IS NOT NULL THEN CAST(8 - (list_position(l, list_min(l)) - 1) AS DOUBLE) END AS lowday FROM x""")
def ts_argext(spark, folder):
    x = c("close")
    return weekly_panel(spark, folder).select("code", "date", ts.ts_argmax(x, 8).alias("argmax"), ts.ts_argmin(x, 8).alias("argmin"), ts.highday(x, 8).alias("highday"), ts.lowday(x, 8).alias("lowday"))


@query(f", x AS (SELECT code, date, count(close) {frame_sql(10)} AS n, quantile_cont(close, 0.8) {frame_sql(10)} AS q8, quantile_cont(close, 0.2) {frame_sql(10)} AS q2 FROM P) SELECT code, date, round(CASE WHEN n >= 7 THEN q8 END, 6) AS q8, round(CASE WHEN n >= 7 THEN q2 END, 6) AS q2 FROM x")
def ts_quantile(spark, folder):
    return rounded(weekly_panel(spark, folder).select("code", "date", ts.ts_quantile(c("close"), 10, 0.8).alias("q8"), ts.ts_quantile(c("close"), 10, 0.2).alias("q2")))


@query(f""", z AS (SELECT *, row_number() {CODE} AS t FROM P), x AS (SELECT code, date, close, t, count(close) {frame_sql(6)} AS n, max(close) {frame_sql(6)} > min(close) {frame_sql(6)} AS v, regr_slope(close, t) {frame_sql(6)} AS b, regr_r2(close, t) {frame_sql(6)} AS r2, regr_intercept(close, t) {frame_sql(6)} AS a FROM z)
SELECT code, date, round(CASE WHEN n = 6 THEN b END, 4) AS slope, round(CASE WHEN n = 6 AND v THEN r2 END, 4) AS r2, round(CASE WHEN n = 6 THEN close - (a + b * t) END, 4) AS resi FROM x""")
def ts_ols(spark, folder):
    x, t = c("close"), c("place")
    return rounded(ts.with_position(weekly_panel(spark, folder)).select("code", "date", ts.ts_slope(x, 6, t).alias("slope"), ts.ts_rsquare(x, 6, t).alias("r2"), ts.ts_resi(x, 6, t).alias("resi")), 4)


def _lag_sum(weights: list[float]) -> str:
    return " + ".join(f"lag(close, {k}) {CODE} * {w!r} / {sum(weights)!r}" for k, w in enumerate(reversed(weights)))


@query(f" SELECT code, date, round({_lag_sum([1.0, 2.0, 3.0, 4.0, 5.0])}, 6) AS decay, round({_lag_sum([0.9**k for k in range(4, -1, -1)])}, 6) AS wma FROM P")
def decay_wma(spark, folder):
    return rounded(weekly_panel(spark, folder).select("code", "date", ts.decay_linear(c("close"), 5).alias("decay"), ts.wma(c("close"), 5).alias("wma")))


@query(f""", l AS (SELECT code, date, list(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM P),
r AS (SELECT code, date, list_reduce(list_transform(l, lambda v: {{'y': v, 'old': 1.0}}), lambda s, v: CASE WHEN v.y IS NULL THEN {{'y': s.y, 'old': s.old * (1 - 2.0 / 7)}} WHEN s.y IS NULL THEN {{'y': v.y, 'old': 1.0}} ELSE {{'y': (s.old * (1 - 2.0 / 7) * s.y + 2.0 / 7 * v.y) / (s.old * (1 - 2.0 / 7) + 2.0 / 7), 'old': 1.0}} END).y AS y FROM l)
SELECT code, date, round(y, 6) AS sma FROM r""")
def ewm_sma(spark, folder):
    # A code's rows are walked once; as a Column every row folds its own frame.
    return rounded(series.with_series(weekly_panel(spark, folder).select("code", "date", "close"), {"sma": ("sma", ("close",), (7, 2))}).drop("close"))


@query(""", q AS (SELECT code, date, close, quantile_cont(close, 0.05) OVER (PARTITION BY date) AS lo, quantile_cont(close, 0.95) OVER (PARTITION BY date) AS hi, (rank() OVER (PARTITION BY date, close IS NULL ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(close) OVER (PARTITION BY date) AS r FROM P),
w AS (SELECT *, CASE WHEN close IS NOT NULL THEN greatest(least(close, hi), lo) END AS w FROM q),
z AS (SELECT *, (w - avg(w) OVER (PARTITION BY date)) / CASE WHEN stddev_pop(w) OVER (PARTITION BY date) > 1e-12 THEN stddev_pop(w) OVER (PARTITION BY date) END AS z FROM w)
SELECT code, date, round(CASE WHEN close IS NOT NULL THEN r END, 6) AS rank, round(w, 6) AS winsor, round(CASE WHEN z IS NOT NULL THEN greatest(least(z, 3.0), -3.0) END, 6) AS z, round(close / sum(abs(close)) OVER (PARTITION BY date), 6) AS scaled FROM z""")
def cs_rank_z(spark, folder):
    # A date's codes are one group of arrays; as Columns a task holds each section several times, and a map of its values for each quantile.
    made = {"rank": ("csrank", ("close",), ()), "winsor": ("winsor", ("close",), (0.05,)), "z": ("winsorz", ("close",), (0.05, 3.0)), "scaled": ("scale", ("close",), ())}
    return rounded(series.with_series(weekly_panel(spark, folder).select("code", "date", "close"), made, "date", "code").drop("close"))


@query(RET_SQL + f""", u AS (SELECT *, coalesce(ret > 0, false) AS up FROM R), g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) {CODE} AS grp FROM u)
SELECT code, date, CAST(CASE WHEN up THEN row_number() OVER (PARTITION BY code, grp ORDER BY date) - CASE WHEN grp = 0 THEN 0 ELSE 1 END ELSE 0 END AS BIGINT) AS run FROM g""")
def run_length(spark, folder):
    from pyspark.sql import Window

    up = ret_panel(spark, folder).withColumn("up", F.coalesce(c("ret") > 0, F.lit(False)))
    grouped = up.withColumn("grp", F.sum((~c("up")).cast("int")).over(ts.whole()))
    place = F.row_number().over(Window.partitionBy("code", "grp").orderBy("date")) - F.when(c("grp") == 0, 0).otherwise(1)
    return grouped.select("code", "date", F.when(c("up"), place).otherwise(0).cast("long").alias("run"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), f AS (SELECT min(date) AS f FROM d),
x AS (SELECT date, f, date + to_days(CAST((5 - isodow(date) + 7) % 7 AS INTEGER)) AS fri, f + to_days(CAST((5 - isodow(f) + 7) % 7 AS INTEGER)) AS ffri FROM d, f)
SELECT 'W-FRI' AS freq, max(date) AS date FROM x GROUP BY fri UNION ALL SELECT 'ME', max(date) FROM x GROUP BY last_day(date)
UNION ALL SELECT '2W-FRI', max(date) FROM x GROUP BY CAST(ceil(date_diff('day', CAST(ffri AS DATE), CAST(fri AS DATE)) / 14.0) AS INTEGER) UNION ALL SELECT '3D', max(date) FROM x GROUP BY date_diff('day', f, date) // 3""")
def rebalance_dates(spark, folder):
    dates = table(spark, folder, "orders").select(c("o_orderdate").cast("date").alias("date")).distinct()
    out = None
    for freq in ("W-FRI", "ME", "2W-FRI", "3D"):
        one = calendar.rebalance_dates(dates, freq).select(F.lit(freq).alias("freq"), "date")
        out = one if out is None else out.union(one)
    return out


@query(", x AS (SELECT *, last_day(date) AS period FROM P) SELECT code, CAST(period AS DATE) AS period, round(arg_max(close, date) FILTER (close IS NOT NULL), 6) AS close, arg_max(volume, date) FILTER (volume IS NOT NULL) AS volume FROM x GROUP BY code, period")
def resample_monthly(spark, folder):
    return rounded(calendar.resample_last(weekly_panel(spark, folder), ["close", "volume"], "ME"))


BUCKET_SQL = """, k AS (SELECT *, row_number() OVER (PARTITION BY date, score IS NULL ORDER BY score, code) AS rn, count(*) OVER (PARTITION BY date, score IS NULL) AS n FROM S),
B AS (SELECT *, CASE WHEN score IS NOT NULL AND n >= 5 THEN CAST(greatest(1, ceil((rn - 1) * 5 / CAST(greatest(n - 1, 1) AS DOUBLE))) AS INTEGER) END AS bucket FROM k)"""
SCORE_SQL = f", S0 AS (SELECT *, -(close / lag(close, 4) {CODE} - 1) AS score, lead(close, 4) {CODE} / CASE WHEN lead(open, 1) {CODE} <> 0 THEN lead(open, 1) {CODE} END - 1 AS fwd, close / lag(close) {CODE} - 1 AS ret FROM P), S AS (SELECT S0.*, industry, sector FROM S0 LEFT JOIN I ON I.code = S0.code)"


def scored(spark, folder):
    """A reversal score over four weeks, the return of the next four, and the industry."""
    panel = weekly_panel(spark, folder).withColumns({"score": -(c("close") / ts.delay(c("close"), 4) - 1), "fwd": ic.forward_return(c("close"), c("open"), 4), "ret": c("close") / ts.delay(c("close"), 1) - 1})
    return with_industry(spark, folder, panel)


@query(SCORE_SQL + BUCKET_SQL + " SELECT code, date, bucket FROM B")
def quantile_buckets(spark, folder):
    return scored(spark, folder).select("code", "date", cs.buckets(c("score"), 5).alias("bucket"))


TOP_SQL = ", T AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place FROM S WHERE score IS NOT NULL QUALIFY place <= 5)"


@query(SCORE_SQL + TOP_SQL + " SELECT date, code, CAST(place AS INTEGER) AS place FROM T")
def top_n(spark, folder):
    return portfolio.top_n(scored(spark, folder), "score", 5).select("date", "code", "place")


@query(SCORE_SQL + " SELECT date, code, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS INTEGER) AS place FROM S WHERE score IS NOT NULL QUALIFY place <= greatest(1, ceil(count(*) OVER (PARTITION BY date) * 0.1))")
def top_fraction(spark, folder):
    return portfolio.top_fraction(scored(spark, folder), "score", 0.1).select("date", "code", "place")


@query(SCORE_SQL + TOP_SQL + """, dd AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM P)),
u AS (SELECT date, code, 1 AS a, 0 AS b FROM T UNION ALL SELECT nx, code, 0, 1 FROM T JOIN dd USING (date) WHERE nx IS NOT NULL), v AS (SELECT date, code, max(a) AS a, max(b) AS b FROM u GROUP BY 1, 2)
SELECT date, CAST(sum(a) AS BIGINT) AS held, count(*) FILTER (a = 1 AND b = 0) AS bought, count(*) FILTER (a = 0 AND b = 1) AS sold,
 round(CASE WHEN sum(b) = 0 THEN 1.0 ELSE (count(*) FILTER (a <> b)) / (2.0 * count(*)) END, 6) AS turnover,
 round(CASE WHEN sum(b) = 0 THEN 1.0 ELSE (count(*) FILTER (a <> b)) / (2.0 * count(*)) END / 2 * (0.0003 + 0.0005) + CASE WHEN sum(b) = 0 THEN 1.0 ELSE (count(*) FILTER (a <> b)) / (2.0 * count(*)) END / 2 * (0.0003 + 0.001 + 0.0005), 8) AS cost FROM v GROUP BY date""")
def turnover(spark, folder):
    panel = scored(spark, folder)
    out = portfolio.turnover(portfolio.top_n(panel, "score", 5).select("date", "code"), panel.select("date").distinct())
    return out.withColumns({"cost": F.round(portfolio.cost_of(c("turnover")), 8), "turnover": F.round("turnover", 6)})


IC_SQL = """, rk AS (SELECT date, sector, industry, code, score, fwd, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY date, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 END AS x,
 CASE WHEN fwd IS NOT NULL THEN rank() OVER (PARTITION BY date, fwd IS NULL ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 END AS y FROM S),
IC AS (SELECT date, corr(x, y) AS ic, count(*) AS n FROM rk WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY date HAVING count(*) >= 10)"""


@query(SCORE_SQL + " SELECT code, date, round(fwd, 6) AS fwd, round(CASE WHEN fwd IS NOT NULL THEN greatest(least(fwd, quantile_cont(fwd, 0.99) OVER (PARTITION BY date)), quantile_cont(fwd, 0.01) OVER (PARTITION BY date)) END, 6) AS winsorized FROM S")
def forward_return(spark, folder):
    return rounded(scored(spark, folder).select("code", "date", "fwd", cs.winsorize(c("fwd"), 0.01).alias("winsorized")))


@query(SCORE_SQL + IC_SQL + " SELECT date, round(CASE WHEN isfinite(ic) THEN ic END, 6) AS ic, n FROM IC")
def ic_series(spark, folder):
    return rounded(ic.ic_series(scored(spark, folder), "score", "fwd", 10))


@query(SCORE_SQL + """, j AS (SELECT * FROM S WHERE score IS NOT NULL AND fwd IS NOT NULL), jr AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS y FROM j)
SELECT date, round(CASE WHEN isfinite(corr(x, y)) THEN corr(x, y) END, 6) AS ic, count(*) AS n FROM jr GROUP BY date HAVING count(*) >= 10""")
def ic_joint(spark, folder):
    return rounded(ic.joint_ic_series(scored(spark, folder), "score", "fwd", 10))


STATS_SQL = """, st AS (SELECT {by} count(*) AS n, avg(greatest(least(ic, 0.3), -0.3)) AS ic_mean, stddev_pop(greatest(least(ic, 0.3), -0.3)) AS ic_std, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS up_rate, avg(CASE WHEN ic < -1e-12 THEN 1.0 ELSE 0.0 END) AS down_rate FROM {src} WHERE isfinite(ic) {group})
SELECT {by} n, round(ic_mean, 6) AS ic_mean, round(ic_std, 6) AS ic_std, round(up_rate, 6) AS up_rate, round(CASE WHEN ic_std > 0 THEN ic_mean / ic_std ELSE 0 END, 5) AS icir, round(CASE WHEN ic_std > 0 THEN ic_mean / ic_std ELSE 0 END * sqrt(n), 4) AS t_stat,
 round(CASE WHEN ic_mean < -1e-12 THEN down_rate ELSE up_rate END, 6) AS win_rate FROM st"""


def _stats(df):
    return df.drop("down_rate").withColumns({n: F.round(n, d) for n, d in (("ic_mean", 6), ("ic_std", 6), ("up_rate", 6), ("icir", 5), ("t_stat", 4), ("win_rate", 6))})


@query(SCORE_SQL + IC_SQL + STATS_SQL.format(by="", src="IC", group=""))
def ic_stats(spark, folder):
    return _stats(ic.ic_stats(ic.ic_series(scored(spark, folder), "score", "fwd", 10)))


@query(SCORE_SQL + IC_SQL + ", IY AS (SELECT year(date) AS year, ic FROM IC)" + STATS_SQL.format(by="year,", src="IY", group="GROUP BY year").replace(" year,", " CAST(year AS INTEGER) AS year,", 0))
def ic_by_year(spark, folder):
    return _stats(ic.ic_stats(ic.ic_series(scored(spark, folder), "score", "fwd", 10).withColumn("year", F.year("date").cast("long")), "year"))


@query(SCORE_SQL + """, rk AS (SELECT date, sector, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY sector, date, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY sector, date, score) - 1) / 2.0 END AS x,
 CASE WHEN fwd IS NOT NULL THEN rank() OVER (PARTITION BY sector, date, fwd IS NULL ORDER BY fwd) + (count(*) OVER (PARTITION BY sector, date, fwd) - 1) / 2.0 END AS y FROM S),
IC AS (SELECT sector, date, corr(x, y) AS ic FROM rk WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY sector, date HAVING count(*) >= 8)""" + STATS_SQL.format(by="sector,", src="IC", group="GROUP BY sector"))
def ic_industry(spark, folder):
    return _stats(ic.ic_stats(ic.ic_series(scored(spark, folder), "score", "fwd", 8, ("sector", "date")), "sector"))


@query(SCORE_SQL + "".join(f", F{h} AS (SELECT {h} AS horizon, date, score, lead(close, {h}) {CODE} / CASE WHEN lead(open, 1) {CODE} <> 0 THEN lead(open, 1) {CODE} END - 1 AS label FROM S)" for h in (1, 4, 8)) + """, AL AS (SELECT * FROM F1 UNION ALL SELECT * FROM F4 UNION ALL SELECT * FROM F8),
rk AS (SELECT horizon, date, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY horizon, date, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY horizon, date, score) - 1) / 2.0 END AS x,
 CASE WHEN label IS NOT NULL THEN rank() OVER (PARTITION BY horizon, date, label IS NULL ORDER BY label) + (count(*) OVER (PARTITION BY horizon, date, label) - 1) / 2.0 END AS y FROM AL),
IC AS (SELECT horizon, date, corr(x, y) AS ic FROM rk WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY horizon, date HAVING count(*) >= 10)""" + STATS_SQL.format(by="horizon,", src="IC", group="GROUP BY horizon"))
def ic_decay(spark, folder):
    return _stats(ic.ic_decay(scored(spark, folder), "score", "close", "open", [1, 4, 8], 10))


@query(SCORE_SQL + IC_SQL + """, e AS (SELECT 'reversal' AS factor, date, ic, ic - avg(ic) OVER () AS e FROM IC WHERE isfinite(ic)), g AS (SELECT factor, ic, e * e AS g0, e * lag(e, 1) OVER (ORDER BY date) AS g1, e * lag(e, 2) OVER (ORDER BY date) AS g2, e * lag(e, 3) OVER (ORDER BY date) AS g3 FROM e),
nw AS (SELECT factor, count(*) AS n, avg(ic) AS mean, (sum(g0) + 2 * 0.75 * coalesce(sum(g1), 0) + 2 * 0.5 * coalesce(sum(g2), 0) + 2 * 0.25 * coalesce(sum(g3), 0)) / count(*) AS v FROM g GROUP BY factor)
SELECT factor, n, round(mean, 6) AS mean, round(CASE WHEN v > 0 THEN mean / sqrt(v / n) END, 4) AS nw_t FROM nw""")
def nw_tstat(spark, folder):
    out = ic.newey_west(ic.ic_series(scored(spark, folder), "score", "fwd", 10).withColumn("factor", F.lit("reversal")), 3)
    return out.withColumns({"mean": F.round("mean", 6), "nw_t": F.round("nw_t", 4)})


@query(SCORE_SQL + f""", b AS (SELECT date, score AS x, lag(score) {CODE} AS y FROM S), j AS (SELECT * FROM b WHERE x IS NOT NULL AND y IS NOT NULL), jr AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS y FROM j)
SELECT date, round(CASE WHEN isfinite(corr(x, y)) THEN 1 - corr(x, y) END, 6) AS turnover, count(*) AS n FROM jr GROUP BY date HAVING count(*) >= 10""")
def rank_turnover(spark, folder):
    return rounded(ic.rank_turnover(scored(spark, folder), "score"))


@query(SCORE_SQL + " SELECT date, count(*) FILTER (score > 0) AS n_trigger, round(avg(fwd) FILTER (score > 0) - avg(fwd), 6) AS edge FROM S WHERE fwd IS NOT NULL GROUP BY date HAVING count(*) FILTER (score > 0) >= 5")
def trigger_payoff(spark, folder):
    return rounded(ic.trigger_payoff(scored(spark, folder), "score", "fwd"))


@query(""", z AS (SELECT l_suppkey AS k, avg(l_discount) AS m, stddev_samp(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS factor, round((m - 0.05) / (s / sqrt(n)), 8) AS t FROM z),
pk AS (SELECT factor, t, 1 / (1 + 0.2316419 * abs(t)) AS k FROM t), p2 AS (SELECT factor, t, 2 * exp(-t * t / 2) / sqrt(2 * 3.141592653589793) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) AS p FROM pk),
r AS (SELECT *, row_number() OVER (ORDER BY p, factor) AS place, count(*) OVER () AS n FROM p2)
SELECT factor, t, round(p, 6) AS p, CAST(place AS INTEGER) AS place, place <= coalesce((SELECT max(place) FROM r WHERE p <= place * 0.2 / n), 0) AS significant FROM r""")
def bh_fdr(spark, folder):
    stats = table(spark, folder, "lineitem").groupBy(F.lpad(c("l_suppkey").cast("string"), 6, "0").alias("factor")).agg(F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"), F.count("*").alias("n"))
    t = stats.select("factor", F.round((c("m") - 0.05) / (c("s") / F.sqrt("n")), 8).alias("t"))
    return ic.benjamini_hochberg(t, "t", 0.2).select("factor", "t", F.round("p", 6).alias("p"), "place", "significant")


LABEL_SQL = """, lr AS (SELECT *, CASE WHEN fwd IS NOT NULL THEN (row_number() OVER (PARTITION BY date, fwd IS NULL ORDER BY fwd, code) - 1) / CAST(greatest(count(fwd) OVER (PARTITION BY date) - 1, 1) AS DOUBLE) END AS r,
 CASE WHEN fwd IS NOT NULL THEN CASE WHEN stddev_pop(fwd) OVER (PARTITION BY date) > 1e-12 THEN (fwd - avg(fwd) OVER (PARTITION BY date)) / stddev_pop(fwd) OVER (PARTITION BY date) ELSE 0 END END AS z FROM S)"""


@query(SCORE_SQL + LABEL_SQL + " SELECT code, date, round(r, 9) AS cs_rank, round(z, 9) AS cs_zscore, round(CASE WHEN r >= 0.6 THEN z WHEN r IS NOT NULL THEN 0 END, 9) AS top_z, round(CASE WHEN r >= 0.6 THEN (r - 0.6::DOUBLE) / 0.4::DOUBLE WHEN r IS NOT NULL THEN (r - 0.6::DOUBLE) / 0.6::DOUBLE * 0.25 END, 9) AS soft_long FROM lr")
def label_modes(spark, folder):
    return rounded(labels.label_modes(scored(spark, folder), "fwd").select("code", "date", "cs_rank", "cs_zscore", "top_z", "soft_long"), 9)


@query(SCORE_SQL + LABEL_SQL + """, tt AS (SELECT *, greatest(0.0, least(1.0, (r - (0.6 - 0.1)) / (2 * 0.1))) AS t FROM lr)
SELECT code, date, CASE WHEN r >= 1 - 0.4 THEN 1.0 WHEN r IS NOT NULL THEN 0.25 END AS step_weight, round(CASE WHEN r IS NOT NULL THEN 0.25 + 0.75 * t * t * (3 - 2 * t) END, 9) AS smooth_weight, round(CASE WHEN r IS NOT NULL THEN 0.6 + 0.4 * pow(2 * abs(r - 0.5), 2) END, 9) AS tail_weight FROM tt""")
def sample_weights(spark, folder):
    panel = scored(spark, folder).withColumn("r", labels.ordinal_rank("fwd"))
    return rounded(panel.select("code", "date", *[w.alias(n) for n, w in labels.sample_weights(c("r")).items()]), 9)


@query(RET_SQL + f""", b AS (SELECT code, date, lead(open, 1) {CODE} AS entry, CASE WHEN count(ret) {frame_sql(20)} >= 10 THEN stddev_samp(ret) {frame_sql(20)} END AS sigma, list(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS path FROM R),
x AS (SELECT *, coalesce(list_position(list_transform(path, lambda v: coalesce(v >= entry * (1 + 1.0 * sigma), false)), true), 0) AS a, coalesce(list_position(list_transform(path, lambda v: coalesce(v <= entry * (1 - 1.0 * sigma), false)), true), 0) AS d FROM b)
SELECT code, date, CAST(CASE WHEN entry IS NOT NULL AND sigma IS NOT NULL THEN CASE WHEN a > 0 AND (d = 0 OR a <= d) THEN 1 WHEN d > 0 THEN -1 ELSE 0 END END AS INTEGER) AS barrier FROM x""")
def triple_barrier(spark, folder):
    return labels.triple_barrier(ret_panel(spark, folder), 6, upper=1.0, lower=1.0).select("code", "date", "barrier")


@query(SCORE_SQL + """, o AS (SELECT *, close * close AS sq, ln(amount) AS size FROM S), f AS (SELECT *, regr_slope(size * size, size) OVER (PARTITION BY date) AS b, regr_intercept(size * size, size) OVER (PARTITION BY date) AS a, count(size) OVER (PARTITION BY date) AS n FROM o)
SELECT code, date, round(CASE WHEN n >= 10 THEN size * size - (a + b * size) END, 4) AS nonlin_size FROM f""")
def nonlin_size(spark, folder):
    panel = scored(spark, folder).withColumn("size", F.ln("amount"))
    return rounded(neutralize.nonlinear_size(panel, "size", least=10).select("code", "date", "nonlin_size"), 4)


@query(SCORE_SQL + """, o AS (SELECT code, date, score, ln(amount) AS size, volume FROM S),
r1 AS (SELECT *, score IS NOT NULL AND size IS NOT NULL AS k FROM o), r2 AS (SELECT *, regr_slope(CASE WHEN k THEN score END, CASE WHEN k THEN size END) OVER (PARTITION BY date) AS b, regr_intercept(CASE WHEN k THEN score END, CASE WHEN k THEN size END) OVER (PARTITION BY date) AS a, count(CASE WHEN k THEN 1 END) OVER (PARTITION BY date) AS n FROM r1)
SELECT code, date, round(size, 6) AS size_orth, round(CASE WHEN k AND n >= 10 THEN score - (a + b * size) END, 5) AS score_orth FROM r2""")
def gram_schmidt(spark, folder):
    out = neutralize.gram_schmidt(scored(spark, folder).withColumn("size", F.ln("amount")), ["size", "score"], 10)
    return out.select("code", "date", F.round("size_orth", 6).alias("size_orth"), F.round("score_orth", 5).alias("score_orth"))


# The SQL takes the industry out by weighted means and then the size by one slope, instead of solving for all at once.
@query(SCORE_SQL + """, wk AS (SELECT date, code, coalesce(CAST(sector AS VARCHAR), 'none') AS grp, score AS y, coalesce(ln(amount), 0) AS x, amount AS w FROM S WHERE score IS NOT NULL),
wd AS (SELECT *, y - sum(w * y) OVER g / sum(w) OVER g AS yt, x - sum(w * x) OVER g / sum(w) OVER g AS xt, count(*) OVER (PARTITION BY date) AS n FROM wk WINDOW g AS (PARTITION BY date, grp)),
wb AS (SELECT *, sum(w * xt * yt) OVER (PARTITION BY date) / nullif(sum(w * xt * xt) OVER (PARTITION BY date), 0) AS beta FROM wd)
SELECT S.date, S.code, round(CASE WHEN n >= 10 THEN yt - coalesce(beta, 0) * xt END, 6) AS score_res FROM S LEFT JOIN wb ON wb.date = S.date AND wb.code = S.code""")
def wls_residual(spark, folder):
    panel = scored(spark, folder).withColumn("size", F.ln("amount"))
    return rounded(neutralize.wls_residuals(panel, ["score"], ["size"], "sector", "amount", 10))


@query()
def ridge_walkforward(spark, folder):
    panel = scored(spark, folder).withColumns({"size": F.ln("amount"), "turn": cs.cs_zscore(c("volume"))})
    panel = panel.withColumns({"f1": cs.cs_zscore(c("score")), "f2": cs.cs_zscore(c("size"))})
    return rounded(neutralize.ridge_walk_forward(panel, ["f1", "f2", "turn"], "fwd", 52, 5, 13))


NAV_SQL = """, q AS (SELECT date, bucket, avg(ret1) AS ret, count(*) AS n FROM (SELECT *, 0.01 * (lead(close, 1) OVER (PARTITION BY code ORDER BY date) / close - 1) AS ret1 FROM B0) WHERE bucket IS NOT NULL GROUP BY date, bucket),
N AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY bucket ORDER BY date)) AS nav FROM q)"""
B0_SQL = BUCKET_SQL.replace("B AS (SELECT *,", "B0 AS (SELECT * EXCLUDE (rn, n),")


def quantile_values(spark, folder):
    panel = scored(spark, folder).withColumn("next", 0.01 * (F.lead("close", 1).over(ts.whole()) / c("close") - 1))  # a hundredth invested
    return portfolio.nav(portfolio.bucket_returns(panel, "score", "next", 5), "bucket")


@query(SCORE_SQL + B0_SQL + NAV_SQL + " SELECT date, bucket, n, round(ret, 6) AS ret, round(nav, 4) AS nav FROM N")
def quantile_nav(spark, folder):
    out = quantile_values(spark, folder)
    return out.select("date", "bucket", "n", F.round("ret", 6).alias("ret"), F.round("nav", 4).alias("nav"))


@query(SCORE_SQL + B0_SQL + NAV_SQL + """, d0 AS (SELECT bucket, date, nav, nav / lag(nav) OVER w - 1 AS ch, nav / coalesce(lag(nav) OVER w, 1.0) - 1 AS ret, nav / max(nav) OVER w - 1 AS dd FROM N WINDOW w AS (PARTITION BY bucket ORDER BY date)),
d AS (SELECT d0.*, b.ch AS bch, b.ret AS bret FROM d0 LEFT JOIN d0 b ON b.bucket = 3 AND b.date = d0.date),
rm AS (SELECT bucket, count(ch) AS n, exp(sum(ln(1 + ch))) AS growth, stddev_samp(ch) * sqrt(52.0) AS vol, stddev_samp(ch) FILTER (ch < -1e-12) * sqrt(52.0) AS fall, -min(dd) AS mdd, avg(ch - bch) / stddev_samp(ch - bch) * sqrt(52.0) AS ir, avg(CASE WHEN ret > 1e-12 THEN 1.0 ELSE 0.0 END) AS win, avg(CASE WHEN ret - coalesce(bret, 0) > 1e-12 THEN 1.0 ELSE 0.0 END) AS beat FROM d GROUP BY bucket),
ra AS (SELECT *, pow(growth, 52.0 / n) - 1 AS ann FROM rm)
SELECT bucket, n AS periods, round(ann, 5) AS annual_return, round(vol, 5) AS volatility, round(ann / vol, 4) AS sharpe, round(ann / CASE WHEN fall > 0 THEN fall END, 4) AS sortino, round(mdd, 5) AS max_drawdown, round(ann / CASE WHEN mdd > 0 THEN mdd END, 4) AS calmar, round(CASE WHEN bucket <> 3 THEN ir END, 4) AS information_ratio, round(win, 6) AS win_rate, round(CASE WHEN bucket <> 3 THEN beat END, 6) AS beat_rate FROM ra""")
def risk_metrics(spark, folder):
    """Buckets held against the middle one."""
    out = portfolio.risk_metrics(quantile_values(spark, folder), "bucket", 52.0, benchmark=3)
    digits = {"annual_return": 5, "volatility": 5, "sharpe": 4, "sortino": 4, "max_drawdown": 5, "calmar": 4, "information_ratio": 4, "win_rate": 6, "beat_rate": 6}
    return out.select("bucket", "periods", *[F.round(n, d).alias(n) for n, d in digits.items()])


@query(RET_SQL + f""", v AS (SELECT code, date, 1 / CASE WHEN sd > 1e-12 THEN sd END AS inv FROM (SELECT code, date, CASE WHEN count(ret) {frame_sql(20)} >= 10 THEN stddev_samp(ret) {frame_sql(20)} END AS sd FROM R))
SELECT * FROM (SELECT code, date, round(coalesce(inv / sum(inv) OVER (PARTITION BY date), CASE WHEN sum(inv) OVER (PARTITION BY date) IS NULL THEN 1.0 / count(*) OVER (PARTITION BY date) END), 6) AS weight FROM v) WHERE weight IS NOT NULL""")
def inv_vol_weights(spark, folder):
    return rounded(portfolio.inverse_volatility(ret_panel(spark, folder), "ret", 20).select("code", "date", "weight"))


# By repetition, unlike the operator: 60 rounds of cutting at the limit and scaling what is below it.
@query(RET_SQL + f""", v AS (SELECT code, date, 1 / CASE WHEN sd > 1e-12 THEN sd END AS inv FROM (SELECT code, date, CASE WHEN count(ret) {frame_sql(20)} >= 10 THEN stddev_samp(ret) {frame_sql(20)} END AS sd FROM R)),
w AS (SELECT * FROM (SELECT code, date, coalesce(inv / sum(inv) OVER (PARTITION BY date), CASE WHEN sum(inv) OVER (PARTITION BY date) IS NULL THEN 1.0 / count(*) OVER (PARTITION BY date) END) AS w FROM v) WHERE w IS NOT NULL),
m AS (SELECT *, greatest(0.02, 1.0 / count(*) OVER (PARTITION BY date)) AS lim FROM w), lists AS (SELECT date, any_value(lim) AS lim, list(w ORDER BY code) AS ws, list(code ORDER BY code) AS cs FROM m GROUP BY date),
done AS (SELECT date, cs, list_reduce(list_prepend(ws, list_transform(range(60), lambda i: [lim])), lambda ws, l: list_transform(ws, lambda x: CASE WHEN x >= l[1] THEN l[1] ELSE x * (1 - l[1] * len(list_filter(ws, lambda y: y >= l[1]))) / list_sum(list_filter(ws, lambda y: y < l[1])) END)) AS ws FROM lists)
SELECT unnest(cs) AS code, date, round(unnest(ws), 6) AS weight FROM done""")
def capped_weights(spark, folder):
    return rounded(portfolio.capped_weights(portfolio.inverse_volatility(ret_panel(spark, folder), "ret", 20).select("code", "date", "weight"), 0.02))


@query()
def constrained_backtest(spark, folder):
    panel = clean.tradable(clean.limit_flags(scored(spark, folder))).withColumn("next", F.lead("close", 1).over(ts.whole()) / c("close") - 1)
    tracks = F.explode(F.array(F.lit("free"), F.lit("sector"))).alias("kind")
    periods = panel.select("*", tracks).withColumn("track", F.when(c("kind") == "free", "all").otherwise(F.concat(F.lit("sector "), c("sector").cast("string"))))
    return rounded(portfolio.constrained_track(periods.select("track", "date", "code", "score", "can_buy", "can_sell", c("next").alias("ret")), 10, 0.3))


@query(SCORE_SQL + """, x AS (SELECT date, score, ret FROM S), q AS (SELECT date, ret, (rank() OVER (PARTITION BY date, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(score) OVER (PARTITION BY date) AS r, score FROM x)
SELECT date, round(avg(ret) FILTER (score IS NOT NULL AND r <= 0.3) - avg(ret) FILTER (score IS NOT NULL AND r >= 0.7), 6) AS spread FROM q GROUP BY date""")
def sleeve_spread(spark, folder):
    ranked = scored(spark, folder).select("date", "ret", cs.cs_rank(c("score")).alias("r"))
    return rounded(ranked.groupBy("date").agg((F.avg(F.when(c("r") <= 0.3, c("ret"))) - F.avg(F.when(c("r") >= 0.7, c("ret")))).alias("spread")))


@query(""", w AS (SELECT date, sum(amount) / sum(volume) AS px FROM P GROUP BY date), m AS (SELECT date, px, CASE WHEN count(px) OVER (ORDER BY date ROWS 4 PRECEDING) >= 5 THEN avg(px) OVER (ORDER BY date ROWS 4 PRECEDING) END AS fast, CASE WHEN count(px) OVER (ORDER BY date ROWS 19 PRECEDING) >= 20 THEN avg(px) OVER (ORDER BY date ROWS 19 PRECEDING) END AS slow FROM w),
s AS (SELECT *, slow - lag(slow, 5) OVER (ORDER BY date) AS slope FROM m)
SELECT date, round(px, 6) AS px, CASE WHEN coalesce(px > fast AND fast > slow AND slope > 0, false) THEN 'bull' WHEN coalesce(px < fast AND fast < slow AND slope < 0, false) THEN 'bear' ELSE 'flat' END AS state FROM s""")
def ma_state(spark, folder):
    index = weekly_panel(spark, folder).groupBy("date").agg((F.sum("amount") / F.sum("volume")).alias("px")).withColumn("code", F.lit("index"))
    lines = index.withColumns({"fast": ts.ts_mean(c("px"), 5, 5), "slow": ts.ts_mean(c("px"), 20, 20)}).withColumn("slope", c("slow") - ts.delay(c("slow"), 5))
    bull = F.coalesce((c("px") > c("fast")) & (c("fast") > c("slow")) & (c("slope") > 0), F.lit(False))
    bear = F.coalesce((c("px") < c("fast")) & (c("fast") < c("slow")) & (c("slope") < 0), F.lit(False))
    return lines.select("date", F.round("px", 6).alias("px"), F.when(bull, "bull").when(bear, "bear").otherwise("flat").alias("state"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_window_agg(spark, folder):
    from .streaming import windows

    return windows.hourly(table(spark, folder, "events"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS date, value FROM events), s AS (SELECT CAST(unnest(generate_series(min(date), max(date) + INTERVAL 2 DAY, INTERVAL 3 DAY)) AS DATE) AS date FROM e),
g AS (SELECT u.user_id, s.date FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN s), d AS (SELECT user_id, s.date, count(*) AS n, sum(value) AS v FROM e JOIN s ON e.date <= s.date AND e.date > s.date - 3 GROUP BY 1, 2)
SELECT CAST(g.user_id AS VARCHAR) AS code, g.date, n, round(v, 6) AS v FROM g LEFT JOIN d ON d.user_id = g.user_id AND d.date = g.date""")
def event_grid(spark, folder):
    """Every event, on the grid date of its day or the next one; the grid spans the table's days."""
    daily = table(spark, folder, "events").select(c("user_id").cast("string").alias("code"), c("ts").cast("date").alias("date"), "value")
    span = daily.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    dates = span.select(F.explode(F.expr("sequence(first, date_add(last, 2), interval 3 days)")).alias("date"))
    grid = daily.select("code").distinct().crossJoin(F.broadcast(dates))
    counted = asof.events_on_grid(grid, daily, F.count("*"), "n", roll=True)
    return asof.events_on_grid(counted, daily, F.round(F.sum("value"), 6), "v", roll=True)


@query(f""", s AS (SELECT code, date, close, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS carried, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date) AS ffilled, sum(volume) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead FROM P)
SELECT code, date, round(carried, 6) AS carried, round(ffilled, 6) AS ffilled, ahead FROM s""")
def carry_forward(spark, folder):
    return rounded(weekly_panel(spark, folder).select("code", "date", ts.carried(c("close"), 3).alias("carried"), ts.carried(c("close")).alias("ffilled"), ts.forward_sum(c("volume"), 4).alias("ahead")))


@query("SELECT l_orderkey, l_linenumber, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) + CAST(CASE quarter(l_shipdate) WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 30 ELSE 90 END AS INTEGER) AS available, round(sign(l_extendedprice / 100 - 300) * ln(1 + abs(greatest(least(l_extendedprice / 100 - 300, 1000), -1000))), 6) AS magnitude FROM lineitem")
def scalar_functions(spark, folder):
    lines = table(spark, folder, "lineitem")
    code = scalars.stock_code(F.concat(F.lpad(c("l_suppkey").cast("string"), 6, "0"), F.lit(".SZ")))
    return rounded(lines.select("l_orderkey", "l_linenumber", code.alias("code"), scalars.available_date(c("l_shipdate").cast("date")).alias("available"), scalars.log_magnitude(c("l_extendedprice") / 100 - 300).alias("magnitude")))


@query(SCORE_SQL + """, icw AS (SELECT date, corr(x, y) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS y FROM S WHERE score IS NOT NULL AND fwd IS NOT NULL) GROUP BY date HAVING count(*) >= 10),
w AS (SELECT date, count(ic) OVER (ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS n, avg(ic) OVER (ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS m, stddev_pop(ic) OVER (ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS s FROM icw)
SELECT date, n, round(m, 6) AS mean, round(CASE WHEN s > 0 THEN m / s END, 5) AS icir, coalesce(n >= 52 AND abs(m) >= 0.015 AND abs(m / s) >= 0.3, false) AS passes FROM w""")
def pool_stats(spark, folder):
    from pyspark.sql import Window

    series = ic.joint_ic_series(scored(spark, folder), "score", "fwd", 10).withColumn("factor", F.lit("score"))
    past = Window.partitionBy("factor").orderBy("date").rowsBetween(-52, -1)
    out = series.select("date", F.count("ic").over(past).alias("n"), F.avg("ic").over(past).alias("mean"), F.stddev_pop("ic").over(past).alias("s")).withColumn("icir", c("mean") / F.when(c("s") > 0, c("s")))
    passes = F.coalesce((c("n") >= 52) & (F.abs("mean") >= 0.015) & (F.abs("icir") >= 0.3), F.lit(False))
    return out.select("date", "n", F.round("mean", 6).alias("mean"), F.round("icir", 5).alias("icir"), passes.alias("passes"))


@query(" SELECT 'close' AS measure, count(*) AS cells, count(close) AS known, round(count(close) / count(*), 6) AS coverage, min(date) AS first, max(date) AS last, count(DISTINCT code) AS codes FROM P UNION ALL SELECT 'volume', count(*), count(volume), round(count(volume) / count(*), 6), min(date), max(date), count(DISTINCT code) FROM P")
def quality_report(spark, folder):
    panel = weekly_panel(spark, folder)
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c(m).alias("v")) for m in ("close", "volume")])).alias("o")
    return panel.select("code", "date", measures).groupBy("o.measure").agg(F.count("*").alias("cells"), F.count("o.v").alias("known"), F.round(F.count("o.v") / F.count("*"), 6).alias("coverage"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("code").alias("codes"))
