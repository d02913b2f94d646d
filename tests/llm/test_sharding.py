from __future__ import annotations

import zlib

from crosspanel.llm.sharding import shard_documents

from .common import documents, texts


def check(rows, got, shards):
    sizes = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(sizes)
    per = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        per.setdefault(r["shard"], []).append(r)
    total = sum(s[1] for s in sizes)
    largest = max(s[1] for s in sizes)
    for shard, members in per.items():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / shards) <= 2 * largest
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in ordered] == sorted(i for i, _ in rows), "shards are contiguous in doc_id"


def test_shards(spark):
    rows = list(enumerate(texts(4, 140)))
    check(rows, shard_documents(documents(spark, rows)).collect(), 8)


def test_repeated_rows_and_few_rows(spark):
    rows = [(1, "same")] * 40 + [(2, "x" * 50)] + [(3, None)] * 3
    check(rows, shard_documents(documents(spark, rows), shards=3).collect(), 3)
    assert shard_documents(documents(spark, [])).count() == 0
    assert [(r["doc_id"], r["slot"]) for r in shard_documents(documents(spark, [(None, "a")])).collect()] == [(None, 0)]


def test_main_path_has_no_python(spark):
    plan = shard_documents(documents(spark, texts(1, 20)))._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


def test_matches_the_sql(spark, tmp_path):
    import duckdb

    from crosspanel.llm.sharding import ORACLE

    rows = [*enumerate(texts(4, 60)), (None, "a"), (None, None), (5, "again"), (5, "again")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM ({ORACLE})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in shard_documents(docs).collect())
