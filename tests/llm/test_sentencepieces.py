from __future__ import annotations

import itertools
import random

import pytest

from crosspanel.llm.sentencepieces import Pieces, decode_documents, encode_and_decode, encode_documents

from .common import documents, texts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["  two  spaces ", "▁mark▁ed", "\t\ttabs\n\n", "12345 a1b2", "don't!!!", "漢字かな交じり文", "👩‍👩‍👧 ok", "é́ combining", "\x00\x01", " ", "                    indent", "....----====", "ﬁ Ａ　x ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ррррр привет мир"]


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_librarys(spark):
    rng = random.Random(0)
    from_pieces = ["".join(library().IdToPiece(rng.randrange(259, 32000)) for _ in range(60)).replace("▁", " ") for _ in range(150)]
    rows = ODD + from_pieces + texts(3, 80)
    got = {r["doc_id"]: r for r in encode_and_decode(documents(spark, rows), PATH).collect()}
    for i, want in enumerate(library().encode([t or "" for t in rows])):
        assert got[i]["ids"] == want, repr(rows[i])
        assert got[i]["n_pieces"] == len(want) and got[i]["round_trip"] == ("▁" not in (rows[i] or ""))


def test_decode_gives_the_texts_back(spark):
    rows = ODD + texts(5, 40)
    encoded = encode_documents(documents(spark, rows), PATH)
    for r in decode_documents(encoded, PATH).collect():
        assert r["decoded"] == (rows[r["doc_id"]] or "").replace("▁", " ")
        assert r["decoded"] == library().decode(r["ids"])


def test_odd_tables(spark):
    assert encode_and_decode(documents(spark, []), PATH).count() == 0
    got = encode_and_decode(documents(spark, [(None, "a"), (2, None), (2, None)]), PATH).collect()
    assert sorted((r["doc_id"] is None, len(r["ids"])) for r in got) == [(False, 0), (False, 0), (True, 1)]


def test_unigram_scores_against_all_segmentations():
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 3))) for _ in range(25)} | {"a", "b", "▁"})
    scores = [-rng.random() * 5 - 1 for _ in pieces]
    model = Pieces(pieces, scores, [True] * len(pieces), None, 0, bpe=False)
    words = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 8))) for _ in range(60)})
    for word, ids in zip(words, model.encode_sorted(words), strict=True):
        assert "".join(pieces[i] for i in ids) == word
        best = max(sum(scores[pieces.index(x)] for x in way) for way in ways(word) if all(x in pieces for x in way))
        assert sum(scores[i] for i in ids) == pytest.approx(best)


def ways(word):
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_models_with_another_normalizer_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    from crosspanel.llm.sentencepieces import load

    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False), lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.pieces[300], "type", 4), lambda m: setattr(m.trainer_spec, "model_type", 4)):
        model = pb.ModelProto()
        with open(PATH, "rb") as file:
            model.ParseFromString(file.read())
        change(model)
        path = tmp_path / "other.model"
        path.write_bytes(model.SerializeToString())
        load.cache_clear()
        with pytest.raises(ValueError):
            load(str(path))
    load.cache_clear()


def test_very_long_text_repeats_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = "some words, 12 of them; " * 100_000
    docs = documents(spark, [(1, long), (1, "a"), (1, "a")])
    for name in ("ids", "n_pieces", "decoded", "round_trip"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted(encode_and_decode(docs, PATH).collect(), key=lambda r: r["n_pieces"])
    assert len(long) > 2 << 20
    assert [r["ids"] for r in got] == [library().encode(t) for t in ("a", "a", long)] and all(r["round_trip"] for r in got)
