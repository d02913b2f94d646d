from __future__ import annotations

import zlib

import numpy as np
import pytest

from crosspanel.llm.token_files import TokenFile, WordEncoder, read_token_files, token_files, write_token_files

from .common import documents, texts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't ''tis I'LL x'sabc 'S", "a<|endoftext|>b <|startoftext|>", "H̱ ≮ é É  x  　 y", "İstanbul ΣΑΣ ﬁ ½ 12ab3", "a\x1cb\x85c\x0bd\x0ce", "﻿x…y—z", "𝕏 👩‍👩‍👧 漢字かな", "A<b>C</b>|d|<", "'", "!!!'t'", "wait…! “so”. a—'s 5€! ½. ٣. ×! ÷- ©, İ! İ's é. ж! ж's ǅ-a", "x’'s ’. ​! ̇! é! é̇! ́. 〉, 〈< ª. ʰ' ²! ⅷ."]


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_files_hold_the_librarys_ids_in_order(spark):
    rows = ODD + texts(6, 110)
    want = library_ids(rows)
    got = sorted(token_files(documents(spark, rows), PATH).collect(), key=lambda r: r["doc_id"])
    assert [r["ids"] for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0] + [len(w) for w in want])[:-1].tolist()
    assert [r["n_tokens"] for r in got] == [len(w) for w in want]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


def test_single_document_access_and_foreign_dictionary(spark, tmp_path):
    rows = texts(7, 60)
    files = write_token_files(documents(spark, rows), PATH, f"file://{tmp_path}/ids")
    want = library_ids(rows)
    found = 0
    for r in files.collect():
        file = TokenFile(r["path"])
        for entry in file.index:
            assert file.document(int(entry["doc_id"])).tolist() == want[entry["doc_id"]]
            found += 1
        with pytest.raises(KeyError):
            file.document(10**6)
    assert found == len(rows)
    (dictionary,) = tmp_path.glob("ids/*.dictionary")
    dictionary.write_bytes(dictionary.read_bytes() + b"x")
    with pytest.raises(ValueError):
        TokenFile(files.first()["path"])


def test_another_process_reads_the_folder_alone(spark, tmp_path):
    import subprocess
    import sys

    rows = texts(7, 30)
    path = write_token_files(documents(spark, rows).coalesce(1), PATH, f"file://{tmp_path}/ids").orderBy("first").first()["path"]
    code = f"from crosspanel.llm.token_files import TokenFile; f = TokenFile({path!r}); print([f.document(int(e['doc_id'])).tolist() for e in f.index])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    file = TokenFile(path)
    assert eval(out) == [library_ids([rows[e["doc_id"]]])[0] for e in file.index] and len(file.index)


def test_large_vocabularies_have_wide_ids(spark, tmp_path, monkeypatch):
    from crosspanel.llm import token_files as tf

    monkeypatch.setattr(tf, "_dtype", lambda size: "<u4")
    rows = texts(7, 20)
    files = write_token_files(documents(spark, rows), PATH, f"file://{tmp_path}/wide")
    monkeypatch.undo()
    got = {r["doc_id"]: r["ids"] for r in read_token_files(spark, files).collect()}
    assert TokenFile(files.first()["path"]).kind == "<u4"
    assert [got[i] for i in range(len(rows))] == library_ids(rows)


def test_long_text_file_cuts_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    long = "plain words and 12 more, " * 100_000
    rows = [(5, long), (6, "a"), (7, "b c")]
    docs = documents(spark, rows).withColumn("tie", F.lit(1)).withColumn("h", F.lit("x")).withColumn("part", F.lit(2))
    files = write_token_files(docs, PATH, f"file://{tmp_path}/long", file_bytes=1 << 20)
    assert len(long.encode()) > 2 << 20 and files.count() >= 2
    got = {r["doc_id"]: r["ids"] for r in read_token_files(spark, files).collect()}
    assert [got[i] for i, _ in rows] == library_ids([t for _, t in rows])


def test_odd_tables(spark):
    assert token_files(documents(spark, []), PATH).count() == 0
    got = token_files(documents(spark, [(4, "a"), (None, None), (4, "a"), (3, "")]), PATH).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"], r["start"]) for r in got] == [(None, 1, 0), (3, 1, 1), (4, 2, 2), (4, 2, 4)]


def test_random_strings_of_signs_letters_digits_and_spaces():
    import random

    import pyarrow as pa

    from crosspanel.llm.bytewords import blocks

    rng = random.Random(9)
    points = [*range(0x20, 0x7F), *range(0xA0, 0x180), *range(0x2000, 0x2070), *range(0x20A0, 0x20C1), *range(0x300, 0x330), *range(0x660, 0x66A), *range(0x2150, 0x2160), *range(0x400, 0x490), *range(0x3000, 0x3010), 0x1680, 0x85, 9, 10, 11, 12, 13, 0x1C, 0x1F600, 0xFEFF]
    marks = "!.,'’…“”—€ sS\"-<>&# İ"
    rows = ["".join(chr(rng.choice(points)) if rng.random() < 0.5 else rng.choice(marks) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    encoder = WordEncoder(PATH)
    got = [ids.tolist() for block in blocks(pa.array(rows), 50_000) for ids in encoder(block)]
    wrong = [(r, g, w[:-1]) for r, g, w in zip(rows, got, library_ids(rows), strict=True) if g != w[:-1]]
    assert not wrong, wrong[:3]


def test_forgetting_the_cache_changes_nothing():
    import pyarrow as pa

    from crosspanel.llm.bytewords import blocks

    rows = [t or "" for t in texts(8, 60)]
    encoder = WordEncoder(PATH)
    encoder.code.limit = 50
    got = [ids.tolist() for block in blocks(pa.array(rows), 2000) for ids in encoder(block)]
    assert got == [ids[:-1] for ids in library_ids(rows)]
