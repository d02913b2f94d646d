from __future__ import annotations

import re
from collections import Counter

from crosspanel.llm.quality_rules import quality_rules

from .common import documents, texts

#: Limits for the small vocabularies of some tests, which compress further than prose.
WIDE = {"band": ((256, 0.35, 2.0), (1024, 0.36, 0.90), (4095, 0.33, 0.80), (4096, 0.28, 0.735), (32768, 0.25, 0.72)), "chunk_share": 0.5}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), failed


def test_base_counts_match_brute_force(spark):
    rows = texts(1, 150)
    got = {r["doc_id"]: r for r in quality_rules(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), repr(text)
        assert not (r["kept"] and r["base_failed"])


def test_repetition_and_noise_are_rejected_and_prose_is_kept(spark):
    import random

    rng = random.Random(3)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(29)) for _ in range(300))
    repeat = " ".join(f"{i % 2} {w}" for i, w in enumerate(["ab cd ef gh ij"] * 2 + ["long unbroken row " + "z" * 9000] * 1 + ["w" * k for k in range(1, 60)]))
    prose = next(t for t in texts(5, 200) if t and 400 < len(t) < 3000 and len(set(t.split())) > 60)
    got = {r["doc_id"]: r["kept"] for r in quality_rules(documents(spark, [noise, repeat, prose]), **WIDE).collect()}
    assert got == {0: False, 1: False, 2: True}


def test_empty_table_and_odd_rows(spark):
    assert quality_rules(documents(spark, [])).count() == 0
    got = quality_rules(documents(spark, [(None, "a b"), (5, None), (5, None)])).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["ratio"] is None, r["kept"]) for r in got) == [(False, 0, True, False), (False, 0, True, False), (True, 2, False, False)]


def test_the_last_piece_counts(spark):
    import base64
    import random

    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = " ".join(rng.choice(vocab) for _ in range(6000))
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    rows = [prose[:4096] + noise(8191), prose[:8192] + noise(4095), prose[:4096], prose[:4097], prose[:12287], prose[:4095], "", noise(4095)]
    got = {r["doc_id"]: (r["n_chunks"], r["n_bad_chunks"]) for r in quality_rules(documents(spark, rows), **WIDE).collect()}
    assert got == {0: (3, 2), 1: (3, 1), 2: (1, 0), 3: (2, 0), 4: (3, 0), 5: (1, 0), 6: (0, 0), 7: (1, 0)}
    assert {r["doc_id"]: r["kept"] for r in quality_rules(documents(spark, rows[:2]), **WIDE).collect()} == {0: False, 1: True}


def _line(size, k):
    """The limits' curve by hand: k = 1 for the least ratio, 2 for the largest."""
    import math

    from crosspanel.llm.quality_rules import BAND

    if size <= BAND[0][0]:
        return BAND[0][k]
    for a, b in zip(BAND, BAND[1:]):  # noqa: B905
        if size <= b[0]:
            part = (math.log2(size) - math.log2(a[0])) / (math.log2(b[0]) - math.log2(a[0]))
            return a[k] + part * (b[k] - a[k])
    return BAND[-1][k]


def brute_bands(text):
    """ratio, chunks, bad chunks and the bands' verdict of a text, one document at a time."""
    import zstandard

    raw = (text or "").encode()
    if not raw:
        return None, 0, 0, False
    ratio_of = lambda b: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b)) / len(b)
    within = _line(len(raw), 1) <= ratio_of(raw) <= _line(len(raw), 2)
    pieces = [raw[a : a + 4096] for a in range(0, len(raw) // 4096 * 4096, 4096)]
    if len(raw) > 4096 and len(raw) % 4096:
        pieces.append(raw[-4096:])
    bad = sum(not _line(4096, 1) - 0.015 <= ratio_of(p) <= _line(4096, 2) + 0.015 for p in pieces)
    if not pieces:
        pieces, bad = [raw], int(not within)
    return ratio_of(raw), len(pieces), bad, within and bad <= 0.2 * len(pieces)


def planted():
    """Texts that pass the base rule: repetitive ones, random ones, and prose of four lengths."""
    import random

    rng = random.Random(17)
    syllables = [a + b + c for a in ("b", "ch", "d", "f", "gr", "l", "m", "n", "p", "s", "st", "tr", "") for b in ("a", "e", "i", "o", "u", "ea", "ie") for c in ("", "d", "n", "r", "s", "st", "t")]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(20_000)]
    weights = [1 / (k + 60) for k in range(20_000)]
    prose = [" ".join(rng.choices(vocabulary, weights, k=n)) for n in (120, 400, 1500, 8000)]
    listed = [" ".join(f"row {i} price {i * 7 % 1000} value {i + 3} stock" for i in range(n)) for n in (40, 300, 3000)]
    menu = ["\n".join(f"{w}-buy-now,free-delivery {w[::-1]}-also-on-offer-today" for w in rng.sample(vocabulary, n)) for n in (60, 800)]
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(12)) for _ in range(n)) for n in (80, 600, 4000)]
    half = prose[2][:6000] + " " + letters[1][:6000]
    return prose, listed + menu, [*letters, half]


def test_bands_decide_on_planted_texts_and_match_brute_force(spark):
    prose, repetitive, random_ones = planted()
    rows = [*prose, *repetitive, *random_ones, *texts(8, 80), "x" * 4096, "y" * 4097, "z"]
    got = {r["doc_id"]: r for r in quality_rules(documents(spark, rows)).collect()}
    for i, text in enumerate(rows):
        ratio, chunks, bad, good = brute_bands(text)
        r = got[i]
        assert (r["n_chunks"], r["n_bad_chunks"], r["kept"]) == (chunks, bad, good and not r["base_failed"]), (i, text[:60] if text else text)
        assert r["ratio"] is None if ratio is None else abs(r["ratio"] - ratio) < 1e-12
    first, second = len(prose), len(prose) + len(repetitive)
    assert [got[i]["kept"] for i in range(first)] == [True] * first
    assert [got[i]["kept"] for i in range(first, second + len(random_ones))] == [False] * (len(repetitive) + len(random_ones))
    # Most of the rejected ones pass the base rule: the bands decide.
    assert sum(not got[i]["base_failed"] for i in range(first, second + len(random_ones))) >= 8


def test_very_long_text_ties_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    prose = planted()[0][3]
    rows = [(1, prose * 60), (1, prose), (1, prose), (2, None)]
    docs = documents(spark, rows).withColumn("kept", F.lit("x")).withColumn("ratio", F.lit(1)).withColumn("n_words", F.lit(2))
    got = sorted((r["doc_id"], r["n_words"], r["n_chunks"]) for r in quality_rules(docs).collect())
    long = brute_bands(prose * 60)
    assert len(rows[0][1].encode()) > 2 << 20
    assert got == sorted([(1, 8000, brute_bands(prose)[1])] * 2 + [(1, len((prose * 60).split()), long[1]), (2, 0, 0)])
