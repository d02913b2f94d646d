from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import hard_negatives as hn
from crosspanel.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_force(rows, positives=5, negatives=5):
    whole = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        whole.append((i, label, [max(-hn.MOST, min(hn.MOST, math.floor(256 * x))) for x in e]))
    dot = lambda a, b: max(-hn.MOST_SCORE, min(hn.MOST_SCORE, sum(x * y for x, y in zip(a, b, strict=True))))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, label, e in whole:
        if i is None or i % 100:
            continue
        scores = [(dot(e, f), j, m) for j, m, f in whole if len(f) == len(e)]
        best = sorted((s for s in scores if s[2] == label and s[1] != i), key=order)[:positives]
        other = sorted((s for s in scores if s[2] != label), key=order)
        for p in best:
            inside = [n for n in other if 80 * p[0] <= 100 * n[0] <= 100 * p[0]][:negatives]
            out += [(i, p[1], k, n[1], p[0], n[0]) for k, n in enumerate(inside, 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, e and [x if x is None else float(x) for x in e], m) for i, e, m in rows], SCHEMA).repartition(4)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    result = hn.hard_negatives(df.withColumn("label", label), F.col("vec_id") % 100 == 0)
    assert result.columns == COLUMNS
    return sorted((tuple(r) for r in result.collect()), key=str)


def table(seed, n=900, dims=6):
    rng = random.Random(seed)
    hub = [rng.gauss(0, 1) for _ in range(dims)]
    rows = [(i, hub if rng.random() < 0.3 else [rng.gauss(0, 1) for _ in range(dims)], rng.randrange(4)) for i in range(n)]
    return rows


@pytest.fixture
def small_trees(monkeypatch):
    """Many trees, leaves, blocks and rounds; the bounds go to tasks with the functions that read them."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 2)
    monkeypatch.setattr(hn, "ROUND", 2)


def test_equals_brute_force_with_a_hot_vector(spark):
    rows = table(1)
    want = brute_force(rows)
    assert mined(frame(spark, rows)) == want and len(want) > 100


def test_many_rounds_of_small_blocks(spark, small_trees):
    rows = table(2)
    assert mined(frame(spark, rows)) == brute_force(rows)


def test_sql_gives_the_same():
    rows = table(3, 400)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows + [(1000, [math.inf] * 6, 1), (1100, None, 1), (1200, [None] * 6, 2), (1300, [1.0] * 6, None)])
    assert sorted(con.execute(hn.ORACLE).fetchall(), key=str) == brute_force(rows)


def test_odd_rows(spark):
    rows = table(4, 250)
    rows += [(None, rows[100][1], 1), (300, [math.nan] * 6, 1), (400, None, 1), (500, [1.0, None, 0, 0, 0, 0], 1), (600, [1.0] * 6, None), (700, [1.0, 2.0], 3), (701, [1.0, 2.0], 3), (702, [1.0, 2.0], 1), (800, [], 2), (801, [], 2), (802, [], 1)]
    rows += [(100, rows[100][1], rows[100][2])] * 2 + [rows[11]] * 3  # repeated rows, an anchor among them
    rows += [(900, [1e300, 1e9, -1e9, 3e6, 0, 0], 5), (901, [1e300, 1e9, -1e9, 0, 0, 0], 5), (902, [1e9, 1e9, -1e9, 0, 0, 5.0], 6), (903, [8e6, 8e6, -8e6, 1, 0, 5.0], 6), (1001, [-1.0] * 6, 9), (1100, [1.0] * 6, 9), (1101, [-2.0] * 6, 9)]
    assert mined(frame(spark, rows)) == brute_force(rows)


def test_empty_and_clashing_columns(spark):
    rows = table(5, 250)
    odd = frame(spark, rows)
    for name in ("block", "query", "rank", "n", "ids", "score"):
        odd = odd.withColumn(name, F.lit("x"))
    assert mined(odd) == brute_force(rows)
    assert mined(frame(spark, []).limit(0)) == []
    assert mined(frame(spark, [(5, [1.0], 1)])) == []


def test_trees_hold_every_row_in_its_balls_and_prune():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 500, (40, 3))
    rows = np.floor(centres[rng.integers(0, 40, 5000)] + rng.normal(0, 5, (5000, 3))).astype(np.int32)
    vectors = hn.Vectors(np.arange(5000), rng.integers(0, 3, 5000), rows)
    tree = hn.build(vectors, 64)
    assert sorted(tree.vectors.ids.tolist()) == list(range(5000))
    for (a, b), c, r in zip(tree.spans, tree.centres, tree.radii, strict=True):
        assert np.linalg.norm(tree.vectors.rows[a:b] - c, axis=1).max() <= r + 1e-9
    queries = hn.Vectors(*(x[:20] for x in vectors))
    scores = queries.rows.astype(np.int64) @ rows.T.astype(np.int64)
    high = np.sort(scores, axis=1)[:, -1500:-1499]
    low = high * 8 // 10
    search = hn.Search(queries, low, high, False, 5)
    search.add(tree)
    for i in range(20):
        inside = [(-s, j) for j, s in enumerate(scores[i].tolist()) if low[i, 0] <= s <= high[i, 0] and vectors.labels[j] != queries.labels[i]]
        assert [(-s, j) for s, j in zip(search.score[i, 0].tolist(), search.id[i, 0].tolist(), strict=True) if s > hn.NONE] == sorted(inside)[:5]
    one = hn.Search(hn.Vectors(*(x[:1] for x in queries)), low[:1], high[:1], False, 5)
    one.add(tree)
    assert one.nodes < len(tree.radii) / 2, one.nodes


def test_query_on_the_given_table_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    assert sorted((tuple(r) for r in queries.op12_hard_negatives(spark, path).collect()), key=str) == sorted(con.execute(hn.ORACLE).fetchall(), key=str)
