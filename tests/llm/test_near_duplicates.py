from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from crosspanel.llm import near_duplicates as nd
from crosspanel.llm.bytewords import U64, mix
from crosspanel.llm.components import connected_components

from .common import documents, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """Least index of each row's class, over all pairs."""
    sets = [shingles(t) for t in rows]
    df = Counter(s for x in sets for s in x)
    weight = lambda s: min(max(math.log(len(rows) / df[s]) / math.log(256), 0.5), 1)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if not a or not b or not (a.keys() & b.keys()):
                continue
            w = sum((1 + math.log(min(a[s], b[s]))) * weight(s) for s in a.keys() & b.keys()) / sum((1 + math.log(max(a[s], b[s]))) * weight(s) for s in a.keys() | b.keys())
            if w >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
                close += 1
    return [root(i) for i in range(len(rows))], close


def edited(rng, text, share):
    w = text.split()
    for k in range(len(w)):
        if rng.random() < share:
            w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def case(n=150):
    rng = random.Random(12)
    rows = texts(11, n)
    bases = [t for t in rows if t and len(t.split()) > 30]
    rows += [edited(rng, rng.choice(bases), rng.choice([0.005, 0.01, 0.03, 0.1])) for _ in range(60)]
    base = bases[0] if len(bases[0].split()) < 400 else " ".join(bases[0].split()[:300])
    rows += [edited(rng, base, 0.02) for _ in range(60)] + [base] * 5
    rows += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(180)) for _ in range(3)]
    rows += [edited(rng, rows[-1], 0.01), rows[-1] + " " + " ".join(f"v{i}" for i in range(20))]
    rng.shuffle(rows)
    return rows


def classes(spark, rows):
    got = nd.near_duplicate_classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: r for r in got}


def test_classes_match_all_pairs(spark):
    rows = case()
    want, close = brute_classes(rows)
    got = classes(spark, rows)
    assert close > 100
    assert [got[i]["class_id"] for i in range(len(rows))] == want
    size = Counter(want)
    assert all(got[i]["class_size"] == size[want[i]] and got[i]["kept"] == (want[i] == i) for i in got)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = case(60)
    want, _ = brute_classes(rows)
    monkeypatch.setattr(nd, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(nd, "TEXT_BLOCK", 6)
    got = classes(spark, rows)
    assert [got[i]["class_id"] for i in range(len(rows))] == want


def test_odd_tables(spark):
    assert nd.near_duplicate_classes(documents(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "!!"), (4, "a b"), (4, "a b"), (None, "a b"), (6, "A, b."), (None, "x")]
    docs = documents(spark, rows)
    got = sorted(((str(r["doc_id"]), r["class_id"], r["class_size"]) for r in nd.near_duplicate_classes(docs).collect()), key=str)
    assert got == [("1", 1, 1), ("2", 2, 1), ("3", 3, 1), ("4", 4, 4), ("4", 4, 4), ("6", 4, 4), ("None", 4, 4), ("None", None, 1)]
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 5


def test_samples_agree_as_weighted_jaccard_says():
    rng = np.random.default_rng(0)
    ids = mix(rng.integers(1, 2**62, 3000).astype(U64))
    wa, wb = rng.uniform(0.5, 3, 2000), None
    a, b = np.sort(ids[:2000]), np.sort(ids[200:2200])
    weights = dict(zip(ids.tolist(), rng.uniform(0.5, 3, 3000), strict=True))
    wa, wb = np.array([weights[x] for x in a.tolist()]), np.array([weights[x] * 1.1 for x in b.tolist()])
    shared = np.intersect1d(a, b)
    low = sum(weights[x] for x in shared.tolist())
    want = low / (wa.sum() + wb.sum() - low)
    for got_a, got_b in ((nd._full(a, np.log(wa), np.array([0])), nd._full(b, np.log(wb), np.array([0]))), (nd._binned(a, np.log(wa), np.zeros(2000, int), 1), nd._binned(b, np.log(wb), np.zeros(2000, int), 1))):
        assert abs((got_a == got_b).mean() - want) < 0.2


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_a_doc_id_with_several_texts_is_several_documents(spark):
    rng = random.Random(8)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4)]
    near = [edited(rng, t, 0.01) for t in prose[:2]]
    rows = [(1, prose[0]), (1, prose[1]), (1, prose[2]), (2, near[0]), (3, near[1]), (4, prose[3]), (4, ""), (4, None)]
    got = nd.near_duplicate_classes(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in got) == [(1, 1, 1, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (3, 1, 2, False), (4, 4, 1, True), (4, 4, 1, True), (4, 4, 1, True)]
    kept = {(r["doc_id"], r["text"]) for r in nd.one_of_each(documents(spark, rows)).collect()}
    assert kept == {(1, prose[0]), (1, prose[1]), (1, prose[2]), (4, prose[3]), (4, ""), (4, None)}
