from __future__ import annotations

import hashlib
import re

from crosspanel.llm.decontamination import benchmark_hits, clean_documents

from .common import documents, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(10, len(iw))
        for a in range(len(iw) - size + 1 if iw else 0):
            for b in range(len(w) - size + 1):
                if w[b : b + size] == iw[a : a + size]:
                    hit.update(range(b, b + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def case(spark):
    rows = texts(2, 90)
    long = [t for t in rows if t and len(t.split()) > 40]
    items = [(10, " ".join(long[0].upper().split()[3:30])), (9, " ".join(long[1].split()[:10])), (2, "smile"), (3, None), (4, ""), (5, "a b a"), (11, " ".join(long[2].split()[5:17])), (12, " ".join(long[2].split()[5:17])), (6, "word " * 12), (7, "no such words stand in any of the texts at all here")]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


def compare(rows, items, got):
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(text, items), repr(text)


def test_hits_match_brute_force(spark):
    rows, items, frame = case(spark)
    compare(rows, items, benchmark_hits(documents(spark, rows), frame))


def test_a_benchmark_in_several_pieces_gives_the_same(spark):
    rows, items, frame = case(spark)
    compare(rows, items, benchmark_hits(documents(spark, rows), frame, piece_bytes=150))


def test_clean_documents_keeps_columns(spark):
    rows, items, frame = case(spark)
    docs = documents(spark, rows)
    want = {i for i, t in enumerate(rows) if not brute(t, items)[-1]}
    for size in (150, 1 << 20):
        got = clean_documents(docs, frame, piece_bytes=size)
        assert got.columns == docs.columns
        assert {r["doc_id"] for r in got.collect()} == want


def test_empty_tables(spark):
    rows, items, frame = case(spark)
    assert benchmark_hits(documents(spark, []), frame).count() == 0
    compare(rows, [], benchmark_hits(documents(spark, rows), frame.where("false")))
    assert clean_documents(documents(spark, rows), frame.where("false")).count() == len(rows)


def test_items_without_an_id_hit(spark):
    rows, items, _ = case(spark)
    long = [t for t in rows if t and len(t.split()) > 40]
    items = [*items, (None, " ".join(long[3].split()[2:20])), (None, " ".join(long[0].split()[3:30])), (None, "")]
    for some in (items, items[-3:]):
        frame = spark.createDataFrame(some, "item_id long, text string")
        for size in (150, 1 << 20):
            compare(rows, some, benchmark_hits(documents(spark, rows), frame, piece_bytes=size))
            want = {i for i, t in enumerate(rows) if not brute(t, some)[-1]}
            assert {r["doc_id"] for r in clean_documents(documents(spark, rows), frame, piece_bytes=size).collect()} == want
    assert any(brute(t, items[-3:])[-1] for t in rows)


def test_very_long_text_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    passage = " ".join(f"q{i}" for i in range(12))
    rows = [(1, "plain words here " * 150_000 + passage), (1, "short"), (2, passage.upper())]
    items = [(7, passage)]
    docs = documents(spark, rows)
    for name in ("key", "hit", "items", "n_words", "item", "item_id", "contaminated"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    assert len(rows[0][1]) > 2 << 20
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 1, 0), (1, 450_012, 12), (2, 12, 12)]
    for piece in (1 << 20, 40):
        kept = clean_documents(docs, spark.createDataFrame([*items, (8, "a b c d e f g h i j k"), (9, "z y x")], "item_id long, text string"), piece_bytes=piece)
        assert kept.columns == docs.columns and [(r["text"], r["key"], r["item_id"]) for r in kept.collect()] == [("short", "own key", "own item_id")]
