"""Coefficients of factors that are freed of controls: many factors, one set of controls for each date.

Rows are (factor, date, code) with the factor's value, the label and the date's controls. A (factor, date) section, of the universe's size, is one group: it is
regressed, ranked and put in buckets there, so that its rows are shuffled once. Dummies of a group are not made: subtracting the group's
weighted means from all columns gives the same residuals. What is left are as many normal equations as there are continuous controls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import timeseries as ts
from ..plans.series import average_ranks, rank_correlation

KEYS = ("factor", "date")
OTHER, UNKNOWN = "other", "none"


def collapsed_groups(panel: DataFrame, group: str, least: int, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """The panel with groups of fewer than `least` rows of a section put together as OTHER; a null group is UNKNOWN. A least of 1 or less changes nothing else."""
    known = F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, known))
    return panel.withColumn(group, F.when(n < least, OTHER).otherwise(known))


def pool_size(panel: DataFrame, cap: str, member: Column, name: str = "size") -> DataFrame:
    """The pool's members with the standardised log of their size: 0 where all agree, null without a size or with fewer than two of them."""
    inside = panel.where(F.coalesce(member, F.lit(False))).withColumn(name, F.when(F.col(cap) > 0, F.ln(cap)))
    over = Window.partitionBy("date")
    std = F.stddev_pop(name).over(over)
    z = F.when(std < 1e-12, 0.0).otherwise((F.col(name) - F.avg(name).over(over)) / F.when(std >= 1e-12, std))
    return inside.withColumn("_z", F.when((F.count(name).over(over) >= 2) & F.col(name).isNotNull(), z)).drop(name).withColumnRenamed("_z", name)


def _freed(section: pa.Table, values: list[str], controls: list[str], group: str | None, weight: str | None) -> list[np.ndarray]:
    """The values of one section, known in all rows, less what the weighted regression on controls, a constant and the group's dummies explains."""
    column = lambda n: pc.fill_null(section.column(n).cast(pa.float64()), np.nan).to_numpy()
    w = np.ones(len(section))
    if weight:
        w = column(weight).copy()
        good = np.isfinite(w) & (w > 0)
        w[~good] = np.median(w[good]) if good.any() else 1.0
    place = np.zeros(len(section), int)
    if group:
        place = pc.fill_null(section.column(group).cast(pa.string()), UNKNOWN).combine_chunks().dictionary_encode().indices.to_numpy()
    total = np.bincount(place, w)
    centred = lambda x: x - (np.bincount(place, w * x) / total)[place]
    x = [centred(np.where(np.isfinite(v), v, 0.0)) for v in map(column, controls)]
    y = [centred(column(v)) for v in values]
    if x:
        x = np.stack(x)
        # The pseudo-inverse: controls that depend on each other leave the residual as it is.
        inverse = np.linalg.pinv((x * w) @ x.T, rcond=1e-12, hermitian=True)
        y = [v - (inverse @ ((x * w) @ v)) @ x for v in y]
    return y


def _known(rows: DataFrame, values: list[str]) -> DataFrame:
    for v in values:
        rows = rows.where(ts.real(F.col(v)).isNotNull())
    return rows


def residuals(rows: DataFrame, values: list[str], controls: list[str], group: str | None = None, weight: str | None = None, least: int = 30) -> DataFrame:
    """rows with <value>_res: per (factor, date) the weighted regression's residual on controls, a constant and the group's dummies.

    Rows where one of the values is null take no part and are left out, as are sections with fewer than `least` rows; a null control counts as 0.
    """
    names = rows.columns
    schema = StructType([*rows.schema.fields, *(StructField(f"{v}_res", DoubleType()) for v in values)])

    def free(section: pa.Table) -> pa.Table:
        section = section.slice(0, len(section) if len(section) >= least else 0)
        freed = _freed(section, values, controls, group, weight) if len(section) else [np.zeros(0)] * len(values)
        return pa.table([*section.columns, *map(pa.array, freed)], names=[*names, *(f"{v}_res" for v in values)])

    return _known(rows, values).groupBy(*KEYS).applyInArrow(free, schema)


def _slim(rows: DataFrame, values: list[str], controls: list[str], group: str | None, weight: str | None, *more: str) -> DataFrame:
    return _known(rows, values).select(*KEYS, *dict.fromkeys([*values, *controls, *([group] if group else []), *([weight] if weight else []), *more]))


def _of_sections(rows: DataFrame, fields: str, least: int, make) -> DataFrame:
    """The section's keys and one row of numbers for each section of at least `least` rows."""
    schema = StructType([*(rows.schema[k] for k in KEYS), *StructType.fromDDL(fields)])
    made = {f.name: pa.int64() if f.dataType == LongType() else pa.float64() for f in schema.fields[len(KEYS) :]}

    def one(section: pa.Table) -> pa.Table:
        numbers = make(section) if len(section) >= least else None
        out = section.select(list(KEYS)).slice(0, 0 if numbers is None else 1)
        for n, t in made.items():
            out = out.append_column(n, pa.array([numbers[n]] if len(out) else [], t))
        return out

    return rows.groupBy(*KEYS).applyInArrow(one, schema)


def pure_ic(rows: DataFrame, value: str, label: str, controls: list[str], group: str | None = None, weight: str | None = None, least: int = 30, digits: int = 9) -> DataFrame:
    """factor, date, ic, n: rank correlation of the factor's residual with the label.

    Residuals that agree to `digits` decimals are ties (a code alone in its group has a residual of 0 up to rounding). A section is regressed and ranked in one group.
    """

    def correlate(section: pa.Table) -> dict:
        x = np.round(_freed(section, [value], controls, group, weight)[0], digits)
        return {"ic": rank_correlation(average_ranks(x), average_ranks(section.column(label).to_numpy())), "n": len(section)}

    return _of_sections(_slim(rows, [value, label], controls, group, weight), "ic double, n long", least, correlate)


def pure_means(series: DataFrame) -> DataFrame:
    """Mean coefficient and number of dates of each factor."""
    return series.groupBy("factor").agg(F.avg("ic").alias("pure_ic"), F.count("ic").alias("n"))


def missing_names(wanted: DataFrame, series: DataFrame) -> DataFrame:
    """wanted(factor) without those that have a coefficient already."""
    return wanted.join(series.where("ic is not null").select("factor").distinct(), "factor", "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both runs' rows; a factor of the new run replaces all rows that it had."""
    return old.join(new.select("factor").distinct(), "factor", "left_anti").unionByName(new)


def pure_spread(rows: DataFrame, value: str, label: str, controls: list[str], group: str | None = None, weight: str | None = None, n: int = 5, least: int = 30, residual_label: bool = True, digits: int = 9) -> DataFrame:
    """factor, date and the highest and lowest of n buckets of the factor's residual, turned so that its mean coefficient isn't negative.

    residual_label: whether the label is freed of the controls too. sign is -1 where the factor was turned.
    """
    turns = {1: "up", -1: "down"}

    def both_ways(section: pa.Table) -> dict:
        section = section.take(pc.sort_indices(section, sort_keys=[("code", "ascending")]))
        freed = _freed(section, [value, label] if residual_label else [value], controls, group, weight)
        x, raw = np.round(freed[0], digits), section.column(label).to_numpy()
        y, size = freed[1] if residual_label else raw, len(section)
        bucket = np.arange(size) * n // size
        out = {"ic": rank_correlation(average_ranks(x), average_ranks(raw)), "n": size, "all": y.mean()}
        for sign, turn in turns.items():
            order = np.argsort(sign * x, kind="stable")
            for name, k in (("low", 0), ("high", n - 1)):
                found = y[order[bucket == k]]
                out[f"{name}_{turn}"] = found.mean() if len(found) else None
        return out

    fields = "ic double, n long, all double, low_up double, high_up double, low_down double, high_down double"
    daily = _of_sections(_slim(rows, [value, label], controls, group, weight, "code"), fields, least, both_ways)
    # The sign is that of the mean over all dates; a factor has one row for each date here.
    sign = F.when(F.avg("ic").over(Window.partitionBy("factor")) < 0, -1).otherwise(1)
    turned = daily.withColumn("sign", sign)
    low, high = (F.when(F.col("sign") > 0, F.col(f"{k}_up")).otherwise(F.col(f"{k}_down")).alias(k) for k in ("low", "high"))
    return turned.select(*KEYS, "sign", "n", low, high, "all").select(*KEYS, "sign", "n", "low", "high", (F.col("high") - F.col("all")).alias("long_excess"), (F.col("all") - F.col("low")).alias("short_contribution"), (F.col("high") - F.col("low")).alias("spread"))
