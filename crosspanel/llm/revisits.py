"""Not-modified revisits of web archives, resolved against earlier full responses.

A revisit record (a 304 answer, without payload) takes the payload and the headers of the latest
earlier full response with the same canonical URL, if its validators hold: its entity tag
equals that response's by weak comparison, or, where it has none, its Last-Modified is the same.
Headers that a 304 answer may change are taken from the revisit, all others from the response.

The as-of join runs over ranges: slim records are sorted into ranges of (URL, time) and written,
so that a URL with a great many records spans several ranges. Inside a range a window carries
the last full response forward; each range's last one, a row for each URL and range, is
carried on to the ranges that follow. Payloads don't travel.

Defined cases: of records at the same time the one with the smaller record_id is earlier; a null
URL, or a null time, resolves to nothing; repeated records are each resolved; a full response with
a null payload counts as one with an empty payload; header names are compared in lower case, of names that
differ in case only the last in order wins; other columns play no part; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Headers that a 304 answer may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
_TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and the default port, path without closing slashes, query
    sorted and without tracking parameters; scheme and fragment dropped."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _lower_names(headers: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: F.size(F.filter(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda x: x["key"] == e["key"])) == 0)
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit of records(record_id, kind, url, time, headers, payload_md5, payload_bytes).

    kind: 'response' or 'revisit'; time: any ordered type; headers: map of strings. Returns
    record_id, canonical_url, source_record_id (the latest earlier full response), matched (etag,
    last-modified, mismatch, unvalidated or no-response), resolved, headers, payload_md5 and payload_bytes.
    """
    spark = records.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        (F.col("kind") == "response").alias("full"),
        canonical_url(F.col("url")).alias("url"),
        F.col("time"),
        _lower_names(F.col("headers")).alias("headers"),
        F.when(F.col("kind") == "response", F.coalesce("payload_md5", F.md5(F.lit("")))).alias("payload_md5"),
        F.when(F.col("kind") == "response", F.coalesce("payload_bytes", F.lit(0).cast("long"))).alias("payload_bytes"),
    ).where("full is not null")
    placed = written(slim.repartitionByRange(ranges, "url", "time", "record_id").withColumn("range", F.spark_partition_id()), "revisit_ranges")

    response = F.when(F.col("full") & F.col("url").isNotNull() & F.col("time").isNotNull(), F.struct("record_id", "headers", "payload_md5", "payload_bytes"))
    earlier = Window.partitionBy("range", "url").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("inside", F.last(response, ignorenulls=True).over(earlier))
    tails = placed.groupBy("range", "url").agg(F.max_by(response, F.when(response.isNotNull(), F.struct("time", "record_id"))).alias("tail"))
    before = tails.select("range", "url", F.last("tail", ignorenulls=True).over(Window.partitionBy("url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = inside.where("not full").join(before, ["range", "url"], "left").withColumn("source", F.when(F.col("url").isNotNull() & F.col("time").isNotNull(), F.coalesce("inside", "before")))

    theirs, ours = F.col("source.headers"), F.col("headers")
    matched = (
        F.when(F.col("source").isNull(), "no-response")
        .when(ours["etag"].isNotNull(), F.when(_strong(ours["etag"]) == _strong(theirs["etag"]), "etag").otherwise("mismatch"))
        .when(ours["last-modified"].isNotNull(), F.when(ours["last-modified"] == theirs["last-modified"], "last-modified").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    judged = found.withColumn("matched", matched).withColumn("resolved", F.col("matched").isin("etag", "last-modified"))
    update = F.map_filter(ours, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k)), update)
    only = lambda c: F.when(F.col("resolved"), c)
    return judged.select("record_id", F.col("url").alias("canonical_url"), F.col("source.record_id").alias("source_record_id"), "matched", "resolved", only(merged).alias("headers"), only(F.col("source.payload_md5")).alias("payload_md5"), only(F.col("source.payload_bytes")).alias("payload_bytes"))


def header_lines(headers: Column) -> Column:
    """A map of headers as sorted name=value pairs."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """An archive made of the pages table: for each page(page_id, url, html) its full response, a
    later revisit and, for every seventh page, a revisit before it; validators vary with page_id."""
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    text = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    modified, kind = text("d", page % 1000), page % 4

    def headers(**values: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in values.items()])
        return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))

    def revisit(offset: int, time: Column) -> DataFrame:
        etag = F.when(kind == 0, tag).when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 2, F.lit('"other"'))
        fields = headers(Date=text("t", time), ETag=etag, Last_Modified=F.when(kind == 3, modified), Cache_Control=F.lit("max-age=120"), Content_Length=F.lit("0"), Expires=text("e", time), X_Cache=F.lit("hit"))
        return pages.select((page * 4 + offset).alias("record_id"), F.lit("revisit").alias("kind"), "url", time.alias("time"), fields.alias("headers"), F.lit(None).cast("string").alias("payload_md5"), F.lit(None).cast("long").alias("payload_bytes"), "page_id")

    full = pages.select(
        (page * 4 + 1).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 10).alias("time"),
        headers(Content_Type=F.lit("text/html"), Content_Length=F.octet_length("html").cast("string"), ETag=tag, Last_Modified=modified, Date=text("t", page * 10), Cache_Control=F.lit("max-age=60")).alias("headers"),
        F.md5("html").alias("payload_md5"), F.octet_length("html").cast("long").alias("payload_bytes"), "page_id",
    )
    return full.union(revisit(2, page * 10 + 10 * (page % 13 + 1) + 5)).union(revisit(3, page * 10 - 5).where("page_id % 7 = 0")).drop("page_id")


ORACLE = r"""
WITH p AS (
  SELECT page_id, html, '"' || md5(html) || '"' AS tag,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest
  FROM pages
), u AS (
  SELECT page_id, html, tag, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))), '&') AS q
  FROM p
), c AS (SELECT page_id, html, tag, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM u),
full_ AS (SELECT page_id * 4 + 1 AS record_id, url, page_id * 10 AS t, page_id, tag, html FROM c),
rev AS (
  SELECT page_id * 4 + 2 AS record_id, url, page_id * 10 + 10 * (page_id % 13 + 1) + 5 AS t, page_id, tag FROM c
  UNION ALL SELECT page_id * 4 + 3, url, page_id * 10 - 5, page_id, tag FROM c WHERE page_id % 7 = 0
), j AS (
  SELECT r.record_id, r.url, r.t, r.page_id, r.tag, f.record_id AS src, f.tag AS ftag, f.page_id AS fpage, f.html,
    CASE r.page_id % 4 WHEN 0 THEN r.tag WHEN 1 THEN 'W/' || r.tag WHEN 2 THEN '"other"' END AS etag,
    CASE WHEN r.page_id % 4 = 3 THEN 'd' || (r.page_id % 1000) END AS lm
  FROM rev r LEFT JOIN full_ f ON f.url = r.url AND f.t < r.t
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.t DESC NULLS LAST, f.record_id DESC) = 1
), m AS (
  SELECT *, CASE WHEN src IS NULL THEN 'no-response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = ftag THEN 'etag' ELSE 'mismatch' END
    WHEN lm IS NOT NULL THEN CASE WHEN lm = 'd' || (fpage % 1000) THEN 'last-modified' ELSE 'mismatch' END
    ELSE 'unvalidated' END AS matched FROM j
)
SELECT record_id, url AS canonical_url, src AS source_record_id, matched, matched IN ('etag', 'last-modified') AS resolved,
  CASE WHEN matched IN ('etag', 'last-modified') THEN
    'cache-control=max-age=120;content-length=' || strlen(html) || ';content-type=text/html;date=t' || t || ';etag=' || coalesce(etag, ftag)
    || ';expires=e' || t || ';last-modified=d' || (fpage % 1000) END AS headers,
  CASE WHEN matched IN ('etag', 'last-modified') THEN md5(html) END AS payload_md5,
  CASE WHEN matched IN ('etag', 'last-modified') THEN strlen(html) END AS payload_bytes
FROM m
"""
