from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import byte_bpe
from crosspanel.llm.bytewords import blocks

from .common import documents, texts

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["don't I'LL 's 'S x'sabc", "<|endoftext|> a", "a \n b\n\n c  d\t e \r\n", "a\xa0 b \xa0c\x85 d  e　 f", " lead", "trail ", "   ", "\x1c\x1f x\x00 \x00y", "12ab３４½ ٣٤", "“quote” – … € ¿", "漢字かな 한국어 ไทย", "👩‍👩‍👧 \U0001f600é é", "aaaaaaaaaaaaaaaaaaaaaaa", "ab" * 4000, "  a  b"]


@pytest.fixture(scope="module")
def library():
    merges = byte_bpe.load(PATH)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


def by_definition(ranks, word):
    """The lowest rank first, of equal ones the leftmost, one merge at a time."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1))
        if best[0] == 10**9:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def test_replay_equals_single_merges_for_random_words_and_vocabularies():
    for seed in range(30):
        rng = random.Random(seed)
        ranks = {bytes([b]): b for b in range(256)}
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 40:  # ranks in no order that a training would give, so that later merges make earlier pairs
            tokens.append(rng.choice(tokens) + rng.choice(tokens))
        rest = list(dict.fromkeys(t for t in tokens if len(t) > 1))
        rng.shuffle(rest)
        ranks.update({t: 256 + i for i, t in enumerate(rest)})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(200)]
        assert byte_bpe.Merges(ranks).replay(words) == [by_definition(ranks, w) for w in words]


def test_replay_of_random_bytes_equals_the_library(library):
    rng = random.Random(1)
    tokens = list(byte_bpe.load(PATH).ranks)
    words = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))) for _ in range(3000)] + [rng.randbytes(rng.randint(1, 40)) for _ in range(1000)]
    assert byte_bpe.load(PATH).ids_of(words) == [library._core_bpe.encode_single_piece(w) for w in words]


def test_blocks_equal_the_library_on_random_strings(library):
    rng = random.Random(2)
    alphabet = [*"abcXYZ '019 \n\t.,!-", " ", "  ", "'s", "'ll", "\xa0", " ", "　", "\x85", "\x1c", "é", "ж", "漢", "か", "“", "€", "٣", "\U0001f600", " ", "\x0b"]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ODD
    encoder = byte_bpe.ByteEncoder(byte_bpe.load(PATH), PATTERN)
    encoder.code.limit = 20_000
    got = []
    for block in blocks(pa.array(rows), 3000):
        ids, count = encoder(block)
        got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [library.encode_ordinary(t) for t in rows]


def test_digests_equal_the_library(spark, library):
    rows = ODD + texts(6, 110) + ["plain words, and 12 more " * 100_000]
    got = {r["doc_id"]: r for r in byte_bpe.encode_and_decode(documents(spark, rows), PATH, PATTERN).collect()}
    for i, t in enumerate(rows):
        ids = library.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_ids_and_texts_come_back_among_clashing_columns(spark, library):
    rows = [(1, "a b"), (1, "a b"), (None, None), (3, ""), (4, "“x” 漢字")]
    docs = documents(spark, rows).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    encoded = byte_bpe.encode_documents(docs, PATH, PATTERN)
    back = byte_bpe.decode_documents(encoded.withColumn("Decoded", F.lit(0)), PATH).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["ids"], r["decoded_"]) for r in back), key=key) == sorted(((i, library.encode_ordinary(t or ""), t or "") for i, t in rows), key=key)
    assert byte_bpe.encode_and_decode(documents(spark, []), PATH, PATTERN).count() == 0


def test_another_pattern_and_foreign_ids():
    merges = byte_bpe.load(PATH)
    encoder = byte_bpe.ByteEncoder(merges, r"[^,]+|,", whole_texts=True)
    (block,) = blocks(pa.array(["one two,three"]))
    assert encoder(block)[0].tolist() == [i for w in (b"one two", b",", b"three") for i in merges.ids_of([w])[0]]
    with pytest.raises(ValueError):
        byte_bpe.ByteDecoder(merges)(np.array([10**6]), np.array([1]))
    with pytest.raises(ValueError):
        byte_bpe.Merges({b"a": 0})
