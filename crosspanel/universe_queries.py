"""Queries of universes, trade rules and cleaning. A code's shares, status and dates are derived from its number and its prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars
from .functions import timeseries as ts
from .operators import clean, universe
from .queries import CODE, SCORE_SQL, c, frame_sql, query, rounded, scored
from .sources.panel import table, weekly_panel

CAP = ", C AS (SELECT *, close * (CAST(code AS INTEGER) % 50 + 1) * 1000000.0::DOUBLE AS cap, CASE WHEN CAST(code AS INTEGER) % 3 > 0 THEN close * (CAST(code AS INTEGER) % 50 + 1) * 700000.0::DOUBLE END AS float_cap FROM P)"
LIQUID = f"CASE WHEN count(amount) {frame_sql(20)} >= 10 THEN avg(amount) {frame_sql(20)} END"


def sized(spark, folder):
    """The panel with total and float capitalisation."""
    number = c("code").cast("int")
    return weekly_panel(spark, folder).withColumns({"cap": c("close") * (number % 50 + 1) * F.lit(1000000.0), "float_cap": F.when(number % 3 > 0, c("close") * (number % 50 + 1) * F.lit(700000.0))})


@query(f" SELECT code, date, round({LIQUID}, 6) AS liquidity FROM P")
def liquidity_average(spark, folder):
    return weekly_panel(spark, folder).select("code", "date", F.round(universe.liquidity(c("amount")), 6).alias("liquidity"))


@query(CAP + f" SELECT code, date, coalesce(cap BETWEEN 5e9 AND 3e10, false) AND coalesce({LIQUID} >= 20000, false) AS member, CASE WHEN coalesce(cap BETWEEN 5e9 AND 3e10, false) AND coalesce({LIQUID} >= 20000, false) THEN round(close, 6) END AS close FROM C")
def small_cap_universe(spark, folder):
    out = sized(spark, folder).withColumn("member", universe.small_cap(c("cap"), c("amount"), 5e9, 3e10, 20000))
    return out.select("code", "date", "member", F.when(c("member"), F.round("close", 6)).alias("close"))


@query(CAP + ", L AS (SELECT *, " + LIQUID + " AS liquid FROM C) SELECT code, date, " + """true AS "all", coalesce(cap BETWEEN 30e8 AND 150e8, false) AND coalesce(liquid >= 10000, false) AS small, coalesce(cap BETWEEN 50e8 AND 300e8, false) AND coalesce(liquid >= 10000, false) AS small_mid,
 coalesce(cap BETWEEN 100e8 AND 500e8, false) AND coalesce(liquid >= 10000, false) AS mid, coalesce(cap BETWEEN 8e8 AND 30e8, false) AND coalesce(liquid >= 10000, false) AS micro, coalesce(cap BETWEEN 20e8 AND 500e8, false) AND coalesce(liquid >= 10000, false) AS small_mid_wide,
 coalesce(cap BETWEEN 0 AND 100e8, false) AND coalesce(liquid >= 10000, false) AS micro_small_100, coalesce(cap BETWEEN 0 AND 30e8, false) AND coalesce(liquid >= 10000, false) AS micro_30, coalesce(cap BETWEEN 0 AND 30e8, false) AND coalesce(liquid >= 10000, false) AS micro_lt30 FROM L""")
def cap_bands(spark, folder):
    return sized(spark, folder).select("code", "date", *[universe.cap_band(n, c("cap"), c("amount"), 10000).alias(n) for n in universe.BANDS])


@query(CAP + " SELECT code, date, coalesce(cap / 1e8 BETWEEN 30 AND 100, false) AS member FROM C")
def cap_absolute_band(spark, folder):
    return sized(spark, folder).select("code", "date", universe.cap_unit_band(c("cap"), 30, 100).alias("member"))


SHARE_SQL = CAP + """, SR AS (SELECT *, date = max(date) OVER (PARTITION BY date_trunc('month', date)) AS decides, CASE WHEN cap IS NOT NULL THEN (rank() OVER (PARTITION BY date, cap IS NULL ORDER BY cap) + (count(*) OVER (PARTITION BY date, cap) - 1) / 2.0) / count(cap) OVER (PARTITION BY date) END AS r FROM C),
SM AS (SELECT *, coalesce(last_value(CASE WHEN decides THEN coalesce(r <= 0.3, false) END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS member FROM SR)"""


@query(SHARE_SQL + " SELECT code, date, member FROM SM")
def cap_percentile_universe(spark, folder):
    return universe.smallest_share(sized(spark, folder), "cap", 0.3).select("code", "date", "member")


@query(SHARE_SQL + """, x AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM SM), ins AS (SELECT code, date, CASE WHEN member THEN ret END AS v FROM x),
w AS (SELECT *, count(v) OVER d AS n, quantile_cont(v, 0.01) OVER d AS lo, quantile_cont(v, 0.99) OVER d AS hi FROM ins WINDOW d AS (PARTITION BY date)), b AS (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN n >= 10 AND v IS NOT NULL THEN greatest(least(v, hi), lo) ELSE v END END AS bv FROM w),
s AS (SELECT *, avg(bv) OVER (PARTITION BY date) AS m, stddev_pop(bv) OVER (PARTITION BY date) AS sd FROM b) SELECT code, date, round(CASE WHEN bv IS NOT NULL THEN CASE WHEN sd >= 1e-12 THEN greatest(least((bv - m) / sd, 3), -3) ELSE 0 END END, 6) AS z FROM s""")
def restandardise_in_mask(spark, folder):
    panel = universe.smallest_share(sized(spark, folder), "cap", 0.3).withColumn("ret", c("close") / ts.delay(c("close"), 1) - 1)
    return rounded(universe.restandardise(panel, "ret", "member").select("code", "date", "z"))


@query(SCORE_SQL + " SELECT code, date, round(CASE WHEN volume > 50 THEN score END, 6) AS x, round(CASE WHEN volume > 50 THEN fwd END, 6) AS y FROM S WHERE volume IS NOT NULL")
def pairwise_mask(spark, folder):
    panel = scored(spark, folder)
    mask = panel.where("volume is not null").select("code", "date", (c("volume") > 50).alias("ok"))
    return rounded(universe.pairwise(panel.select("code", "date", c("score").alias("x")), panel.select("code", "date", c("fwd").alias("y")), mask))


@query(", m AS (SELECT code, date, volume > 30 AS a, close > open AS b FROM P) SELECT code, date, coalesce(a, false) AND coalesce(b, false) AS both_true, coalesce(a, false) AS one FROM m")
def mask_conjunction(spark, folder):
    a, b = c("volume") > 30, c("close") > c("open")
    return weekly_panel(spark, folder).select("code", "date", universe.conjunction(a, b).alias("both_true"), universe.conjunction(a, None).alias("one"))


LIMITS_SQL = f""", L0 AS (SELECT *, close / lag(close) {CODE} - 1 AS ch FROM P), L1 AS (SELECT *, coalesce(close = high AND ch >= 0.095::DOUBLE * 0.98::DOUBLE, false) AS lu, coalesce(close = low AND ch <= -(0.095::DOUBLE * 0.98::DOUBLE), false) AS ld FROM L0),
LX AS (SELECT *, lu AND coalesce(open = close, false) AS luo, ld AND coalesce(open = close, false) AS ldo FROM L1),
LD AS (SELECT code, min(date) FILTER (close IS NOT NULL) AS list_date, CASE WHEN CAST(code AS INTEGER) % 7 = 0 THEN max(date) - 200 END AS delist_date FROM P GROUP BY code),
TR AS (SELECT LX.*, NOT coalesce(close > 0 AND volume > 0, false) AS suspended, coalesce(LX.date > delist_date, false) AS delisted, CAST(LX.code AS INTEGER) % 9 = 0 AND year(LX.date) % 2 = 0 AS special, coalesce(LX.date - list_date >= 60, true) AS aged FROM LX LEFT JOIN LD ON LD.code = LX.code),
T AS (SELECT *, NOT suspended AND NOT delisted AND NOT special AND aged AND NOT luo AS can_buy, NOT suspended AND NOT ldo AS can_sell FROM TR)"""


def ruled(spark, folder):
    panel = clean.limit_flags(weekly_panel(spark, folder))
    seen = panel.groupBy("code").agg(F.min(F.when(c("close").isNotNull(), c("date"))).alias("list_date"), F.max("date").alias("last"))
    number = c("code").cast("int")
    flags = panel.where((number % 9 == 0) & (F.year("date") % 2 == 0)).select("code", "date")
    return universe.trade_rules(panel, seen.select("code", "list_date"), seen.where(number % 7 == 0).select("code", F.date_sub("last", 200).alias("delist_date")), flags)


@query(LIMITS_SQL + " SELECT code, date, suspended, delisted, special, aged, can_buy, can_sell FROM T")
def trade_rules(spark, folder):
    return ruled(spark, folder).select("code", "date", "suspended", "delisted", "special", "aged", "can_buy", "can_sell")


@query(LIMITS_SQL + ", e AS (SELECT max(date) AS latest FROM P WHERE close IS NOT NULL) SELECT code, date, NOT suspended AND NOT delisted AND NOT special AND aged AND NOT (lu OR ld) AS member FROM T, e WHERE date = latest")
def live_strict_mask(spark, folder):
    """Tradability on the last date with a close."""
    rows = ruled(spark, folder)
    at = rows.where("close is not null").agg(F.max("date").alias("at"))
    member = universe.conjunction(~c("suspended"), ~c("delisted"), ~c("special"), c("aged"), ~c("any_limit"))
    return rows.join(F.broadcast(at), c("date") == c("at")).select("code", "date", member.alias("member"))


@query(LIMITS_SQL + f", g AS (SELECT *, lead(close, 4) {CODE} / lead(open, 1) {CODE} - 1 AS fwd, -(close / lag(close, 4) {CODE} - 1) AS score FROM T) SELECT code, date, round(CASE WHEN can_buy AND NOT (lu OR ld) AND fwd IS NOT NULL THEN score END, 6) AS score, round(score, 6) AS training FROM g")
def score_gate(spark, folder):
    from .operators import ic

    rows = ruled(spark, folder).withColumns({"fwd": ic.forward_return(c("close"), c("open"), 4), "score": -(c("close") / ts.delay(c("close"), 4) - 1)})
    gate = universe.conjunction(c("can_buy"), ~c("any_limit"))
    return rounded(rows.select("code", "date", universe.score_gate(c("score"), gate, c("fwd")).alias("score"), universe.score_gate(c("score"), gate, c("fwd"), training=True).alias("training")))


@query("""WITH raw AS (SELECT unnest([lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ', '200' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0'), '8' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') || '.BJ', 'sh' || CAST(s_suppkey + 60000 AS VARCHAR), CAST(s_suppkey % 100 AS VARCHAR)]) AS raw FROM supplier),
n AS (SELECT raw, regexp_replace(regexp_replace(trim(raw), '\\..*$', ''), '\\D', '', 'g') AS d FROM raw), k AS (SELECT raw, CASE WHEN length(d) >= 5 THEN lpad(d, CAST(greatest(length(d), 6) AS INTEGER), '0') ELSE raw END AS code FROM n)
SELECT raw, code, regexp_matches(code, '^(200|900)') AS b_share, regexp_matches(code, '^(8|200|900)') AS excluded FROM k""")
def code_predicates(spark, folder):
    key = c("s_suppkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    forms = F.array(F.concat(pad(key, 6), F.lit(".SZ")), F.concat(F.lit("200"), pad(key % 1000, 3)), F.concat(F.lit("8"), pad(key % 100000, 5), F.lit(".BJ")), F.concat(F.lit("sh"), (key + 60000).cast("string")), (key % 100).cast("string"))
    rows = table(spark, folder, "supplier").select(F.explode(forms).alias("raw")).withColumn("code", scalars.stock_code(c("raw")))
    return rows.select("raw", "code", scalars.is_b_share(c("code")).alias("b_share"), scalars.is_excluded(c("code")).alias("excluded"))


@query("SELECT p_partkey, p_name, contains(upper(p_name), 'ST') AS special FROM part")
def flagged_names(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_name", universe.flagged_by_name(c("p_name")).alias("special"))


@query("""WITH f AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS trade_date, o_custkey AS code, o_orderkey, o_totalprice / 100000 - 1 AS margin, o_totalprice / 1000 AS debt FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY trade_date, code ORDER BY o_orderkey DESC) AS r FROM f)
SELECT trade_date, code, round(CASE WHEN margin BETWEEN -0.5 AND 2 THEN margin END, 9) AS margin, round(CASE WHEN debt BETWEEN 0 AND 200 THEN debt END, 9) AS debt FROM k WHERE r = 1 AND trade_date <= DATE '2100-01-01'""")
def financial_cleaning(spark, folder):
    rows = table(spark, folder, "orders").select(F.trunc("o_orderdate", "quarter").alias("trade_date"), c("o_custkey").alias("code"), "o_orderkey", (c("o_totalprice") / 100000 - 1).alias("margin"), (c("o_totalprice") / 1000).alias("debt"))
    return rounded(universe.cleaned_reports(rows, {"margin": (-0.5, 2), "debt": (0, 200)}, "o_orderkey", F.lit("2100-01-01").cast("date")).drop("o_orderkey"), 9)


@query(CAP + ", n AS (SELECT count(float_cap) AS a, count(cap) AS b FROM C) SELECT code, date, round(CASE WHEN a >= 0.5 * b THEN float_cap ELSE cap END, 1) AS cap FROM C, n")
def cap_source(spark, folder):
    return universe.coverage_choice(sized(spark, folder).withColumnRenamed("cap", "total_cap"), "float_cap", "total_cap").select("code", "date", F.round("cap", 1).alias("cap"))


@query(CAP + f", m AS (SELECT code, date, CASE WHEN date = max(date) OVER (PARTITION BY code, date_trunc('month', date)) THEN cap END AS cap FROM C) SELECT code, date, round(last_value(cap IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 1) AS cap FROM m")
def cap_resample(spark, folder):
    """Month-end sizes carried to the dates after them, seven rows at most."""
    from pyspark.sql import Window

    last = F.max("date").over(Window.partitionBy("code", F.trunc("date", "month")))
    return sized(spark, folder).withColumn("cap", F.when(c("date") == last, c("cap"))).select("code", "date", F.round(ts.carried(c("cap"), 7), 1).alias("cap"))


@query(" SELECT date, count(close) AS members, round(count(close) / count(*), 6) AS known_share FROM P GROUP BY date")
def sparsity_profile(spark, folder):
    return weekly_panel(spark, folder).groupBy("date").agg(F.count("close").alias("members"), F.round(F.count("close") / F.count("*"), 6).alias("known_share"))


@query(f""", d AS (SELECT code, CASE WHEN CAST(code AS INTEGER) % 7 = 0 THEN max(date) - 200 END AS delist_date FROM P GROUP BY code), k AS (SELECT P.*, close / lag(close) {CODE} AS up, lead(close) {CODE} AS nx, lag(close) {CODE} AS pv FROM P)
SELECT k.code, date, CASE WHEN delist_date IS NULL OR date <= delist_date THEN round(close, 6) END AS close, CASE WHEN delist_date IS NULL OR date <= delist_date THEN volume END AS volume FROM k JOIN d ON d.code = k.code""")
def post_delisting_mask(spark, folder):
    panel = weekly_panel(spark, folder)
    ends = panel.groupBy("code").agg(F.date_sub(F.max("date"), 200).alias("delist_date")).where(c("code").cast("int") % 7 == 0)
    return rounded(clean.masked_after(panel, ends, ["close", "volume"]).select("code", "date", "close", "volume"))


@query(" SELECT code, date, CASE WHEN volume - 20 >= 0 THEN volume - 20 END AS volume, CASE WHEN amount - 40000 > 0 THEN round(amount - 40000, 4) END AS cap, round(amount - 40000, 4) AS aux FROM P")
def value_cleaning(spark, folder):
    """Volumes keep zero, sizes don't, auxiliary values keep their sign."""
    return weekly_panel(spark, folder).select("code", "date", clean.clean_nonnegative(c("volume") - 20).alias("volume"), F.round(clean.clean_positive(c("amount") - 40000), 4).alias("cap"), F.round(universe.signed_aux(c("amount") - 40000), 4).alias("aux"))
