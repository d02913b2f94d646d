from __future__ import annotations

import re

from crosspanel.llm.license_scan import BASE, OWN, scan_licenses

from .common import documents, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def brute(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    base = [(i, BASE[p]) for p in BASE for i in places(words, p)]
    own = {OWN[p] for p in OWN if places(words, p)}
    at = [i for i, _ in base]
    labels = {x for _, x in base}
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own))


ROWS = [
    "Released under the MIT License.",
    "MIT-License mit\nLICENSE, the Apache License, Version 2.0. x GNU General Public License, version 3!",
    "general public licenses; general public; mit licence; mitlicense; KMIT License",
    "license mit license license apache license mit",
    "Licensed under CC BY-NC 4.0. " * 3,
    "éMIT License MITé License",
    "general general public license",
]


def test_matches_brute_force(spark):
    rows = ROWS + texts(9, 60) + [f"{t} Apache License. {t}" for t in texts(9, 40) if t]
    got = {r["doc_id"]: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == brute(text), repr(text)
        assert 0 <= r["score"] <= 1
        if r["labels"]:
            assert r["score"] > 0.99


def test_odd_tables_and_plan(spark):
    empty = scan_licenses(documents(spark, []))
    assert empty.count() == 0
    got = scan_licenses(documents(spark, [(None, "mit license"), (1, None), (1, None)]))
    assert sorted((r["n_words"], r["n_base"], r["score"]) for r in got.collect()) == [(0, 0, 0.0), (0, 0, 0.0), (2, 1, 1.0)]
    plan = got._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


def test_edited_licence_texts_are_found_by_their_rare_words(spark):
    import random

    from crosspanel.llm.license_scan import TEMPLATES

    rng = random.Random(3)
    filler = [t for t in texts(9, 60) if t and len(t.split()) > 20]
    rows, want = [], []
    for label, (text, phrase) in TEMPLATES.items():
        words = text.split()
        rows.append(f"{rng.choice(filler)}\n# {text.upper()}.\n{rng.choice(filler)}")
        # Some words replaced, outside the mandatory phrase, and one put in at the end.
        at = next(k for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        edited = [w if at <= k < at + len(phrase.split()) or rng.random() > 0.15 else "xyz" for k, w in enumerate(words)]
        rows.append(f"{rng.choice(filler)} {' '.join(edited)} more")
        # Without the mandatory phrase it is none.
        rows.append(" ".join(words[:at] + ["gap"] * len(phrase.split()) + words[at + len(phrase.split()) :]))
        want += [(label, True), (label, True), (label, False)]
    got = {r["doc_id"]: r for r in scan_licenses(documents(spark, rows)).collect()}
    for i, (label, there) in enumerate(want):
        assert (label in got[i]["labels"].split(",")) == there, (label, rows[i])
        base = brute(rows[i])
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == base[:5]
        if there:
            assert got[i]["score"] > 0.5
    assert [got[i]["score"] > 0.99 for i in range(0, len(rows), 3)] == [True] * len(TEMPLATES)


def test_score_of_short_phrases_matches_brute_force(spark):
    import math

    rows = [*ROWS, *texts(9, 30), "eclipse public licence here", "spdx-license identifier"]
    got = {r["doc_id"]: r["score"] for r in scan_licenses(documents(spark, rows), templates={}).collect()}
    tokens = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in rows]
    keyed = [w for w, t in zip(tokens, rows, strict=True) if re.search("(?i)licen|permission|redistribution|reserved|creative commons|public domain|spdx", t or "")]
    phrases = [p.split() for p in [*BASE, *OWN]]
    idf = {w: math.log((len(keyed) + 2) / (sum(w in set(k) for k in keyed) + 1)) if len(w) > 2 else 0 for p in phrases for w in p}
    for i, words in enumerate(tokens):
        best = 0.0
        if words in keyed:
            for p in phrases:
                rare = min(range(len(p)), key=lambda k, p=p: (-idf[p[k]], k))
                for at in [j - rare for j, w in enumerate(words) if w == p[rare]]:
                    best = max(best, sum(idf[w] for k, w in enumerate(p) if 0 <= at + k < len(words) and words[at + k] == w) / max(sum(idf[w] for w in p), 1e-9))
        assert abs(got[i] - min(best, 1)) < 1e-9, rows[i]


def test_long_text_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = "plain words here " * 150_000 + "MIT License " + "license " * 500
    docs = documents(spark, [(1, long), (1, long), (1, "")])
    for name in ("words", "hits", "candidate", "counted", "at0", "best0", "score"):
        docs = docs.withColumn(name, F.lit(1))
    assert len(long) > 2 << 20
    got = sorted((r["n_words"], r["n_base"], r["first_word"] or 0, r["labels"]) for r in scan_licenses(docs).collect())
    assert got == [(0, 0, 0, "")] + [(450_502, 1, 450_000, "mit")] * 2


def test_everywhere_scores_texts_without_a_key_word(spark):
    import math

    rows = ["the gnu general public terms", *ROWS, *texts(9, 30), "eclipse public licence here", "binary forms of mozilla", "MIT \u212a \u0130", None, ""]
    whole = {r["doc_id"]: r for r in scan_licenses(documents(spark, rows), templates={}, everywhere=True).collect()}
    keyed = {r["doc_id"]: r for r in scan_licenses(documents(spark, rows), templates={}).collect()}
    tokens = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in rows]
    phrases = [p.split() for p in [*BASE, *OWN]]
    idf = {w: math.log((len(rows) + 2) / (sum(w in set(k) for k in tokens) + 1)) if len(w) > 2 else 0 for p in phrases for w in p}
    for i, words in enumerate(tokens):
        best = 0.0
        for p in phrases:
            rare = min(range(len(p)), key=lambda k, p=p: (-idf[p[k]], k))
            for at in [j - rare for j, w in enumerate(words) if w == p[rare]]:
                best = max(best, sum(idf[w] for k, w in enumerate(p) if 0 <= at + k < len(words) and words[at + k] == w) / max(sum(idf[w] for w in p), 1e-9))
        assert abs(whole[i]["score"] - min(best, 1)) < 1e-9, rows[i]
        assert [whole[i][n] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")] == list(brute(rows[i]))
    # The same words have a score with and without a key word beside them.
    assert whole[0]["score"] > 0.4 and keyed[0]["score"] == 0
    both = scan_licenses(documents(spark, ["the gnu general public terms", "the gnu general public terms and a license here", *ROWS]), everywhere=True)
    scores = {r["doc_id"]: r["score"] for r in both.collect()}
    assert scores[0] > 0.3 and abs(scores[0] - scores[1]) < 1e-9


def test_the_query_scores_every_text(spark, tmp_path):
    from crosspanel.llm.queries import op9_license_scan

    documents(spark, ["the gnu general public terms", "MIT License", "nothing"]).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["score"] > 0.3 for r in op9_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()] == [True, True, False]
