"""Panels that grow: merges that keep what is known, factors of new dates from a bounded look back, and a sink for streams that may run a batch twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("code", "date")


def merged(old: DataFrame, new: DataFrame, values: list[str], keys: tuple[str, ...] = KEYS, new_codes_only: bool = False) -> DataFrame:
    """All cells of both tables (a row for each key): the new one's where it isn't null, else the old one's; so no null and no missing row destroys a value.

    new_codes_only: rows of codes that the old table has are left out of the new one. Merging the same rows again changes nothing.
    """
    if new_codes_only:
        new = new.join(old.select(keys[0]).distinct(), keys[0], "left_anti")
    both = old.select(*keys, *(F.col(v).alias(f"_old_{v}") for v in values)).join(new.select(*keys, *(F.col(v).alias(f"_new_{v}") for v in values)), list(keys), "full")
    return both.select(*keys, *(F.coalesce(f"_new_{v}", f"_old_{v}").alias(v) for v in values))


def fresh_rows(panel: DataFrame, last: str | None, rows: int, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute(panel) of the dates after `last`, from those and the `rows` dates up to it; of all dates where there is no last one.

    The date filter reaches the scan of a panel that is partitioned or sorted by date. compute must not look further back than `rows` dates.
    """
    if last is None:
        return compute(panel)
    day = F.lit(last).cast("date")
    earlier = panel.where(F.col("date") <= day).select("date").distinct().orderBy(F.desc("date")).limit(rows)
    first = earlier.agg(F.min("date")).first()[0]  # one date
    recent = panel.where(F.col("date") > day) if first is None else panel.where(F.col("date") >= F.lit(first))
    return compute(recent).where(F.col("date") > day)


def appended(existing: DataFrame, panel: DataFrame, values: list[str], rows: int, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The existing factors and those of the panel's later dates.

    Where the panel has no later date, the existing table's last date is made again, and its cells that come out known replace those there are; everything before it stays.
    """
    last = existing.agg(F.max("date")).first()[0]
    newest = panel.agg(F.max("date")).first()[0]
    if last is not None and newest is not None and newest <= last:
        before = panel.where(F.col("date") < F.lit(last)).agg(F.max("date")).first()[0]
        fresh = fresh_rows(panel, None if before is None else str(before), rows, compute).where(F.col("date") == F.lit(last))
        return merged(existing, fresh, values)
    fresh = fresh_rows(panel, None if last is None else str(last), rows, compute)
    return existing.select(*KEYS, *values).unionByName(fresh.select(*KEYS, *values))


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's rows in a folder of its number, which is written anew if the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, values: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The table that the batches make: each cell's last known value, so a later null destroys nothing. Of rows of one batch with one key the largest value counts."""
    rows = spark.read.parquet(path)
    newest = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.struct("batch", v))).alias(v)
    return rows.groupBy(*keys).agg(*(newest(v) for v in values))


def compacted(spark: SparkSession, path: str, target: str, values: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The current table written as one first batch of another folder, to which a stream can go on."""
    current(spark, path, values, keys).write.mode("overwrite").parquet(f"{target}/batch=-1")
    return current(spark, target, values, keys)
