from __future__ import annotations

import hashlib
import random

import numpy as np

from crosspanel.llm import repeated_spans as rs

from .common import documents, texts


def cuts(rows):
    """For each (doc_id, text): which bytes go, by a table of all strings of 100 bytes."""
    keyed = sorted({(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows}, key=lambda r: r[0])
    seen, out = set(), {}
    for i, text in keyed:
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - 99):
            key = text[a : a + 100]
            if key in seen:
                gone[a : a + 100] = True
            seen.add(key)
        out[i, text] = gone
    return out


def expected(i, text, gone):
    kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
    spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
    return (None if i == -(2**63) else i, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def case():
    rng = random.Random(5)
    rows = texts(13, 110)
    long = [t for t in rows if t and len(t) > 500]
    for _ in range(40):
        t = rng.choice(long)
        a = rng.randrange(len(t) - 200)
        piece = t[a : a + rng.choice([99, 100, 101, 150, 400])]
        rows.append(rng.choice(["", "x", rng.choice(long)[:80]]) + piece + rng.choice(["", "yy", rng.choice(long)[-90:]]))
    rows += ["ab" * 300, "x" * 99, "x" * 100, "é" * 50, "é" * 49 + "x", "same " * 15 + "mid" + "same " * 40]
    rng.shuffle(rows)
    return [(i * 3 % 1000, t) for i, t in enumerate(rows)]


def compare(spark, rows):
    want = sorted(expected(i, text, gone) for (i, text), gone in cuts(rows).items())
    got = rs.repeated_spans(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted({tuple(r) for r in got}) == want


def test_matches_brute_force(spark):
    compare(spark, case())


def test_long_texts_in_parts(spark, monkeypatch):
    rows = case()[:60]
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows += [(5000, base), (5001, "shift" + base), (5002, base[1000:3000] + base[:1000])]
    docs = documents(spark, rows)
    import pyarrow as pa

    want = {(i, t or ""): tuple(len(x) for x in rs.runs(next(rs.blocks(pa.array([t or ""]))))) for i, t in rows if t}
    assert want
    monkeypatch.setattr(rs, "SEGMENT", 700)
    parts = rs.runs(rs.Block(0, np.frombuffer(base.encode(), np.uint8), np.array([0, len(base)])))
    starts = np.sort(np.concatenate([np.arange(a, a + n) for a, n in zip(parts[1], parts[2], strict=True)]))
    assert (starts == np.arange(len(base) - 99)).all()
    monkeypatch.undo()
    want = sorted(expected(i, text, gone) for (i, text), gone in cuts(rows).items())
    assert sorted(tuple(r) for r in rs.repeated_spans(docs).collect()) == want


def test_odd_tables(spark):
    assert rs.repeated_spans(documents(spark, [])).count() == 0
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(None, p), (1, p), (1, p), (2, None), (2, ""), (3, p + "!" + p)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in rs.repeated_spans(documents(spark, rows)).collect()), key=str)
    n = len(p)
    assert got == sorted([(None, 0), (1, n), (1, n), (2, 0), (2, 0), (3, 2 * n)], key=str)
    docs = documents(spark, rows)
    kept = rs.without_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, p), (2, None), (2, ""), (3, "!")], key=str)
    spans = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in rs.removed_spans(docs).collect() if r["doc_id"] == 3}
    assert spans == {3: [(0, n), (n + 1, 2 * n + 1)]}


def test_hot_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(rs, "HOT", 1)
    compare(spark, case())


def test_a_common_passage_among_differing_words(spark):
    """One 60-byte passage with differing surroundings everywhere, then with some that agree."""
    rng = random.Random(6)
    passage = " all rights are reserved by the owners of the said material "
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(90))
    sides = [word() for _ in range(12)]
    rows = [(i, word() + passage + word()) for i in range(80)] + [(100 + i, rng.choice(sides) + passage + rng.choice(sides)) for i in range(60)]
    compare(spark, rows)


def test_clashing_columns_stay(spark):
    from pyspark.sql import functions as F

    p = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [(1, p), (2, p + " more"), (3, "short"), (3, "other")])
    for name in ("_row", "row", "_cleaned", "cleaned", "tie", "_tie", "bare", "null", "bucket", "kind", "raw"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    kept = rs.without_repeats(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"], r["text"], r["row"], r["_cleaned"], r["_tie"], r["raw"]) for r in kept.collect())
    assert got == [(i, t, f"row{i}", f"_cleaned{i}", f"_tie{i}", f"raw{i}") for i, t in [(1, p), (2, " more"), (3, "other"), (3, "short")]]
