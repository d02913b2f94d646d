"""Windows over events; the same transformation serves batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and total by event type and hour. On a stream, hours close `late` after their end."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select("event_type", F.col("window.start").alias("hour"), "n", "total")


def upsert(batch: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Merge a batch into a Parquet table: of rows with equal keys the last in the order stays.

    For foreachBatch. The merged table is written beside the old one and then read by its new
    version; a batch that is run again gives the same rows.
    """
    from pyspark.sql import Window

    spark = batch.sparkSession
    old = latest(spark, path)
    both = batch if old is None else old[1].unionByName(batch)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    version = 0 if old is None else old[0] + 1
    both.withColumn("_place", place).where("_place = 1").drop("_place").write.mode("overwrite").parquet(f"{path}/v{version}")


def latest(spark, path: str) -> tuple[int, DataFrame] | None:
    """The newest complete version of an upserted table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return None
    names = [s.getPath().getName() for s in system.listStatus(hadoop)]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return (max(done), spark.read.parquet(f"{path}/v{max(done)}")) if done else None
