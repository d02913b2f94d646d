from __future__ import annotations

import pytest

from .common import documents
from .test_decontamination import brute as contaminated
from .test_near_duplicates import brute_classes, edited
from .test_quality_classifier import corpus
from .test_repeated_spans import cuts

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages_match_brute_force(spark, tmp_path):
    import random

    from sentencepiece import SentencePieceProcessor

    import corpus_pipeline

    rng = random.Random(9)
    rows, labels = corpus(160)
    good = [t for i, t in rows if i % 4]
    passage = " ".join(good[0].split()[:28])
    rows += [(1000 + i, edited(rng, rng.choice(good), 0.01)) for i in range(25)] + [(2000 + i, good[i + 5] + " " + passage + " " + good[i + 30]) for i in range(12)] + [(3000, good[4]), (3001, good[4])]
    items = [(1, " ".join(good[2].split()[4:16])), (2, " ".join(good[3].split()[:10]))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        got = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert got.columns == docs.columns
        docs = got
        kept.append(sorted((r["doc_id"], r["text"] if k < 4 else r["ids"]) for r in got.collect()))
    bad = {i for i, y in labels if not y}
    assert not bad & {i for i, _ in kept[0]} and len(kept[0]) > 0.9 * (len(rows) - len(bad))
    classes, _ = brute_classes([t for _, t in kept[0]])
    assert kept[1] == [kept[0][i] for i, c in enumerate(classes) if c == i]
    gone = cuts(kept[1])
    want = [(i, bytes(b for b, g in zip(t.encode(), gone[i, t.encode()], strict=True) if not g).decode("utf-8", "ignore")) for i, t in kept[1]]
    assert kept[2] == [(i, t) for i, t in want if t]
    assert kept[3] == [(i, t) for i, t in kept[2] if not contaminated(t, items)[-1]]
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert kept[4] == [(i, library.encode(t)) for i, t in kept[3]]
    assert len(kept[0]) > len(kept[1]) > 0 and len(kept[2]) > len(kept[3]) > 0
    run = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert run == kept[4]


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, and columns named like those the operators use."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    rows, labels = corpus(40)
    odd = [(None, rows[1][1]), (None, None), (500, None), (500, ""), (501, rows[2][1]), (501, rows[3][1]), (502, rows[5][1]), (502, rows[5][1])]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words stand in any of these texts at all"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [*rows, *odd])
    for name in ("_row", "row", "tie", "_cleaned", "stats", "label", "node", "key", "ids", "score"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    given = [r for r in docs.collect() if r["text"]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        got = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert got.columns == docs.columns
            assert all(r["_row"] == "own _row" and r["label"] == "own label" and r["stats"] == "own stats" for r in got.collect())
        if k == 1:  # of each text one row stays; ids that come again with other texts stay apart
            kept = [r["text"] for r in got.collect() if r["text"]]
            assert len(kept) == len(set(kept)) and {rows[2][1], rows[3][1], rows[5][1]} <= set(kept) | ({r["text"] for r in given} - {r["text"] for r in docs.collect()})
        docs = got
    assert docs.count() > 20
    empty = documents(spark, [])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        empty = out if k < 4 else empty
