"""The weekly panel of suppliers: one row for each code and week, days without trades as nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Number of the group of codes that a code is dealt into, in panels that are dealt by groups.
GROUP = "_group"


def group_of(code: Column | str, groups: int) -> Column:
    return F.pmod(F.hash(code), F.lit(groups)).alias(GROUP)


def bars(lines: DataFrame, unit: str = "week", groups: int | None = None) -> DataFrame:
    """Open, high, low and close of unit prices, volume and amount of each code and period. A code's lines go to one task, where what follows by code finds them.

    groups: codes are dealt into so many groups, each of which goes to one task.
    """
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    priced = lines.select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"),
        F.date_trunc(unit, "l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        order.alias("at"), "l_quantity", "l_extendedprice",
    )
    priced = priced.repartition("code") if groups is None else priced.withColumn(GROUP, group_of("code", groups)).repartition(GROUP)
    return priced.groupBy(*_keys(priced), "date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )


def _keys(panel: DataFrame) -> list[str]:
    return [n for n in (GROUP, "code") if n in panel.columns]


def on_grid(panel: DataFrame, step: str = "interval 7 days", span: Row | None = None) -> DataFrame:
    """A row for every code on every date of the panel's span (first, last), which is found in the panel if it isn't given.

    Each code's rows, one for a date at most, are laid over the sequence of dates within the code's group, so that a panel that is dealt by code needs no further shuffle.
    """
    span = span or panel.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    dates = F.sequence(F.lit(span["first"]).cast("date"), F.lit(span["last"]).cast("date"), F.expr(step))
    keys = _keys(panel)
    values = [n for n in panel.columns if n not in (*keys, "date")]
    entry = F.when(F.col("date").isNotNull(), F.struct(F.col("date").alias("key"), F.struct(*values).alias("value")))
    held = panel.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_held"))
    # As in a join, nothing equals a null code.
    laid = F.transform(dates, lambda d: F.struct(d.alias("date"), F.try_element_at(F.when(F.col("code").isNotNull(), F.col("_held")), d).alias("at")))
    return held.select(*keys, F.explode(laid).alias("o")).select(*keys, "o.date", *[F.col(f"o.at.{n}").alias(n) for n in values])


def weekly_panel(spark: SparkSession, folder: str, size: int | None = None) -> DataFrame:
    """size: deals the panel by groups of about so many codes, whose number is in its column GROUP."""
    lines = table(spark, folder, "lineitem")
    # The bars' span is that of the lines, in whole weeks.
    week = lambda at: F.date_trunc("week", at).cast("date")
    span = lines.agg(week(F.min("l_shipdate")).alias("first"), week(F.max("l_shipdate")).alias("last"), *([F.approx_count_distinct("l_suppkey").alias("codes")] if size else [])).first()
    return on_grid(bars(lines, groups=-(-span["codes"] // size) or 1 if size else None), span=span)


def with_industry(spark: SparkSession, folder: str, panel: DataFrame) -> DataFrame:
    """The supplier's nation as industry, its region as sector. Both dimension tables have a row for each of a fixed list."""
    nation = F.broadcast(table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("industry"), F.col("n_regionkey").alias("sector")))
    supplier = table(spark, folder, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), "s_nationkey")
    return panel.join(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("code", "industry", "sector"), "code", "left")


#: The same panel in SQL, for the oracles.
PANEL_SQL = """
line AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
bar AS (SELECT code, date, first(price ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount FROM line GROUP BY code, date),
span AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date FROM bar),
P AS (SELECT c.code, s.date, open, high, low, close, volume, amount FROM (SELECT DISTINCT code FROM bar) c CROSS JOIN span s LEFT JOIN bar b ON b.code = c.code AND b.date = s.date),
I AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, n_name AS industry, n_regionkey AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""
