from __future__ import annotations

import random
import zlib

import numpy as np

from crosspanel.llm.quality_classifier import _isotonic, classify, good_documents

from .common import documents


def corpus(n=300):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "###" for w in words) if bad and i % 8 else " ".join(words[:4] * 30).upper() if bad else " ".join(words).capitalize() + "."))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_range(spark):
    rows, labels = corpus()
    got = classify(documents(spark, rows + [(900, None), (901, "")]), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) + 2
    truth = dict(labels)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus(120)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in classify(documents(spark, rows), spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, flipped))
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-9)


def test_few_or_no_labels(spark):
    docs = documents(spark, [(1, "a b"), (None, None), (1, "a b")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classify(docs, none).collect()} == {1.0}
    assert {r["score"] for r in classify(docs, spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, quality int")).collect()} == {0.0}
    assert classify(documents(spark, []), none).count() == 0
    kept = good_documents(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3


def test_isotonic_is_monotone():
    x, y = _isotonic(np.arange(6.0), np.array([1, 2, 1, 1, 4, 1.0]), np.array([1, 0, 0, 1, 2, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def brute_scores(stats, fold, y, k=256):
    """Scores from a table of statistics by the textbook: dense features, normal equations, pool adjacent violators."""
    mean, std = stats.mean(axis=0), stats.std(axis=0)
    rng = np.random.Generator(np.random.PCG64(11))
    directions, phases = rng.standard_normal((stats.shape[1], k)) * 0.35, rng.uniform(0, 2 * np.pi, k)
    z = np.clip((stats - mean) / np.where(std > 1e-9, std, 1), -8, 8)
    x = np.hstack([np.sqrt(2 / k) * np.cos(z @ directions + phases), np.ones((len(z), 1))])
    fitted, calibrated = (fold < 2) & ~np.isnan(y), (fold == 3) & ~np.isnan(y)
    penalty = np.eye(k + 1) * 1e-3 * fitted.sum() / k
    penalty[k, k] = 0
    raw = x @ np.linalg.solve(x[fitted].T @ x[fitted] + penalty, x[fitted].T @ y[fitted])
    order = np.flatnonzero(calibrated)[np.argsort(raw[calibrated], kind="stable")]
    values = y[order].copy()
    # Isotonic regression as the largest of the least means of runs (min-max formula).
    sums = np.concatenate([[0], np.cumsum(values)])
    n = len(values)
    means = np.array([[(sums[j + 1] - sums[i]) / (j + 1 - i) if j >= i else np.inf for j in range(n)] for i in range(n)])
    value = np.array([max(means[i, m:].min() for i in range(m + 1)) for m in range(n)])
    pools = np.unique(value)
    knots = np.array([raw[order][value == v].mean() for v in pools])
    return np.interp(raw, knots, pools)


def test_scores_match_brute_force(spark):
    from crosspanel.llm.quality_classifier import statistics_table

    rows, labels = corpus(240)
    rng = random.Random(4)
    labels = [(i, 1 - q if rng.random() < 0.1 else q) for i, q in labels if rng.random() < 0.9]
    docs = documents(spark, rows)
    table = {r["doc_id"]: r for r in statistics_table(docs).collect()}
    ids = sorted(table)
    y = np.array([dict(labels).get(i, np.nan) for i in ids], float)
    want = brute_scores(np.array([table[i]["stats"] for i in ids]), np.array([zlib.crc32(str(i).encode()) % 4 for i in ids]), y)
    got = {r["doc_id"]: r["score"] for r in classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert 3 < len(set(np.round(want, 6)))
    assert np.abs(np.array([got[i] for i in ids]) - want).max() < 1e-3


def test_good_documents_agree_with_scores_and_keep_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows, labels = corpus(120)
    docs = documents(spark, [*rows, (3, None), (3, rows[3][1]), (None, "")]).withColumn("stats", F.lit("own")).withColumn("score", F.lit(7)).withColumn("fold", F.lit(None).cast("string"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    scores = sorted((str(r["doc_id"]), r["score"] >= 0.7) for r in classify(docs, marks).collect())
    kept = good_documents(docs, marks)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(str(r["doc_id"]) for r in got) == [i for i, good in scores if good] and {(r["stats"], r["score"], r["fold"]) for r in got} == {("own", 7, None)}
