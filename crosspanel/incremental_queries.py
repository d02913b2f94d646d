"""Queries of panels that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import timeseries as ts
from .queries import c, frame_sql, query, rounded
from .sources.panel import weekly_panel
from .sources.store import written
from .streaming import incremental

_OLD, _NEW = "date < DATE '2000-01-03' AND CAST(code AS INTEGER) % 7 <> 3", "date >= DATE '1999-07-05'"


@query(f""", o AS (SELECT code, date, close AS a, volume AS b FROM P WHERE {_OLD}), n AS (SELECT code, date, CASE WHEN day(date) % 4 <> 0 THEN close * 2 END AS a, CASE WHEN day(date) % 3 <> 0 THEN volume + 1 END AS b FROM P WHERE {_NEW})
SELECT coalesce(n.code, o.code) AS code, coalesce(n.date, o.date) AS date, round(coalesce(n.a, o.a), 8) AS a, coalesce(n.b, o.b) AS b FROM o FULL JOIN n ON n.code = o.code AND n.date = o.date""")
def incremental_merge(spark, folder):
    """An older table and a newer one that overlap in time, both with gaps."""
    panel = weekly_panel(spark, folder)
    old = panel.where(_OLD.replace("INTEGER", "INT")).select("code", "date", c("close").alias("a"), c("volume").alias("b"))
    new = panel.where(_NEW).select("code", "date", F.when(F.dayofmonth("date") % 4 != 0, c("close") * 2).alias("a"), F.when(F.dayofmonth("date") % 3 != 0, c("volume") + 1).alias("b"))
    return rounded(incremental.merged(old, new, ["a", "b"]), 8)  # prices have seven decimals at most or many more, so no value lies between two roundings


@query(f" SELECT code, date, round(CASE WHEN count(close) {frame_sql(20)} >= 10 THEN avg(close) {frame_sql(20)} END / close, 6) AS m, round(close / lag(close, 12) OVER (PARTITION BY code ORDER BY date) - 1, 6) AS r FROM P")
def incremental_append(spark, folder):
    """Two factors up to the end of 1999, later dates added twice from a look back of 20 dates; the same as made at once."""
    compute = lambda p: p.select("code", "date", (ts.ts_mean(c("close"), 20) / c("close")).alias("m"), (c("close") / ts.delay(c("close"), 12) - 1).alias("r"))
    panel = weekly_panel(spark, folder)
    made = written(compute(panel.where("date < date'2000-01-01'")), "factors")
    for until in ("2000-07-01", None):
        made = written(incremental.appended(made, panel if until is None else panel.where(F.col("date") < until), ["m", "r"], 20, compute), "factors")
    return rounded(made)
