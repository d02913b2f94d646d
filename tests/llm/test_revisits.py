from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from crosspanel.llm.revisits import PERMITTED, canonical_url, resolve_revisits

SCHEMA = "record_id long, kind string, url string, time long, headers map<string,string>, payload_md5 string, payload_bytes long, canonical_url string"


def brute(records):
    out = []
    strong = lambda t: re.sub("^W/", "", t) if t is not None else None
    for r in records:
        if r[1] != "revisit":
            continue
        earlier = [x for x in records if x[1] == "response" and r[2] is not None and x[2] == r[2] and None not in (x[3], r[3]) and (x[3], x[0]) < (r[3], r[0])]
        source = max(earlier, key=lambda x: (x[3], x[0]), default=None)
        ours = {k.lower(): v for k, v in sorted((r[4] or {}).items())}
        if source is None:
            out.append((r[0], None, "no-response", None, None))
            continue
        theirs = {k.lower(): v for k, v in sorted((source[4] or {}).items())}
        if ours.get("etag") is not None:
            matched = "etag" if strong(ours["etag"]) == strong(theirs.get("etag")) else "mismatch"
        elif ours.get("last-modified") is not None:
            matched = "last-modified" if ours["last-modified"] == theirs.get("last-modified") else "mismatch"
        else:
            matched = "unvalidated"
        good = matched in ("etag", "last-modified")
        merged = {**theirs, **{k: v for k, v in ours.items() if k in PERMITTED}} if good else None
        out.append((r[0], source[0], matched, merged, (source[5] or "d41d8cd98f00b204e9800998ecf8427e") if good else None))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    records = []
    for i in range(400):
        full = rng.random() < 0.3
        headers = {k: v for k, v in (("ETag", rng.choice(['"a"', 'W/"a"', '"b"', None])), ("Last-Modified", rng.choice(["m1", "m2", None])), ("Content-Type", rng.choice(["x", None])), ("date", str(i)), ("DATE", "0"), ("X-Y", "1")) if v is not None}
        url = rng.choice(["hot.org/a"] * 8 + ["b.org", "c.org/d", None])
        records.append((i, "response" if full else "revisit", url, rng.choice([None] + [rng.randrange(200)] * 9), headers if rng.random() < 0.95 else None, rng.choice(["x", None]) if full else None, 1 if full else None, "clash"))
    records += [records[5]] * 2
    frame = spark.createDataFrame(records, SCHEMA).repartition(5)
    got = sorted([(r["record_id"], r["source_record_id"], r["matched"], r["headers"], r["payload_md5"]) for r in resolve_revisits(frame).collect()], key=str)
    key = lambda rows: sorted((r[0], r[1], r[2], tuple(sorted(r[3].items())) if r[3] is not None else None, r[4]) for r in rows)
    normal = lambda rows: sorted(map(str, [(r[0], r[1], r[2], sorted(r[3].items()) if r[3] is not None else None, r[4]) for r in rows]))
    assert key and normal(got) == normal(brute(records))
    assert resolve_revisits(frame.where("false")).count() == 0


def test_canonical_urls(spark):
    urls = {"http://WWW.Ex.org:80/A/?utm_source=x&b=2&a=1&ref=z#top": "ex.org/A?a=1&b=2", "https://ex.org/A?a=1&b=2": "ex.org/A?a=1&b=2", "ex.org": "ex.org", "https://ex.org/": "ex.org", "": ""}
    frame = spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in frame.collect()} == urls
