"""Contiguous shards of near-equal bytes, by global prefix sums. DataFrame functions only.

Slim rows (id, size, checksum: no text) are sorted into ranges of doc_id and written, which fixes
each row's range. The bytes of each range are totalled; the running sum of these totals, one row
for each range, gives every range its start, and a running sum inside the range gives every row
its place. A row goes to the shard in whose share of the total its middle byte falls, so that
each shard's size differs from an equal share by less than its two border documents.

Defined cases: a null text has size 1 and the checksum of the empty text; null doc_ids come
first; rows that repeat are told apart by a seeded tie value and each get a slot; an empty table
gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.rand(5).alias("tie"))
    order = ["doc_id", "text_crc32", "size", "tie"]
    placed = written(slim.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "shard_ranges")

    # One row for each range: a bounded table, whatever the number of documents.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (
        placed.groupBy("range")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("bytes_total"))
    )
    inside = Window.partitionBy("range").orderBy(*order)
    middle_twice = 2 * (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    cut = (
        placed.join(F.broadcast(totals), "range")
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle_twice * shards / (2 * F.col("bytes_total")))).cast("int"))
        .withColumn("index", F.col("rows_before") + F.row_number().over(inside) - 1)
    )
    first = cut.groupBy("shard").agg(F.min("index").alias("first"))  # one row for each shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The same law in SQL, for eight shards; the checksum is computed from the bytes, eight steps of division for each table entry.
ORACLE = """WITH fixed AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(('0x' || h) AS BIGINT)) AS b FROM documents),
sized AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM bytes, fixed),
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, CAST(least(7, (2 * upto - size) * 8 // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut"""
