from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import filter_audit

from .common import documents, texts

LABELS = "doc_id long, quality int, toxic int"


def rows_of(docs):
    return [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]


def brute_force(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        smaller = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": smaller,
        }
        failed.append((lang or "", {x for x, f in fails.items() if f}, i in good, i in toxic))
    out = {}
    removed_by = Counter()
    for part in {p for p, *_ in failed}:
        mine = [f for f in failed if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                here = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                removed_by[part, x] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(x in f[1] for f in mine) - len(here), sum(f[1] == {x} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(result):
    rows = result.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def table(spark):
    many = "one two three " * 60  # long enough, but few distinct words
    rows = texts(3, 90) + [many] * 8 + ["SHOUTING " * 3] * 2 + [" ".join(f"w{i}" for i in range(150)) + tail for tail in ("", " $", " A", "")]
    rows += ["".join(chr(97 + (i * i + k) % 26) for i in range(40_000)) + end for k in range(2) for end in ("x", "y", "x")]
    docs = documents(spark, list(enumerate(rows)) + [(None, many), (3, many), (500, many), (500, many), (501, None)])
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, i % 5 == 0 and 1 or None) for i in range(0, 130, 2)] + [(90, 0, 1), (90, 1, 0), (None, 1, 1)], LABELS)
    return docs.cache(), labels.cache()


def test_every_order_equals_brute_force(table):
    docs, labels = table
    want = brute_force(rows_of(docs), [tuple(r) for r in labels.collect()])
    assert got(filter_audit.filter_interactions(docs, labels)) == want
    assert len(want) == 600 * len({k[0] for k in want})


def test_sql_gives_the_same(table):
    docs, labels = table
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null").toPandas())
    con.register("labels", labels.toPandas())
    cursor = con.execute(filter_audit.ORACLE)
    names = [d[0] for d in cursor.description]
    want = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in (dict(zip(names, x, strict=True)) for x in cursor.fetchall())}
    assert got(filter_audit.filter_interactions(docs.where("doc_id is not null"), labels)) == want


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_texts_with_equal_hashes_are_told_apart(table, monkeypatch, broadcast):
    docs, labels = table
    monkeypatch.setattr(filter_audit, "block_hash", lambda text, k: F.lit(7).cast("long"))
    monkeypatch.setattr(filter_audit, "BROADCAST_CLASSES", broadcast)
    assert got(filter_audit.filter_interactions(docs, labels)) == brute_force(rows_of(docs), [tuple(r) for r in labels.collect()])


def test_rounds_drop_documents_alone_in_their_class(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1), (1, 0, 0, 1), (1, 5, 0, 0), (2, 0, 0, 0), (2, 0, 9, 0), (3, 0, 0, 0)], "length long, b0 long, b1 long, b2 long")
    assert filter_audit.refined_classes(rows).count() == 1


def test_empty_tables_and_clashing_columns(spark, table):
    docs, labels = table
    assert filter_audit.filter_interactions(documents(spark, []), labels).count() == 0
    odd = docs.limit(40).cache()
    plain = got(filter_audit.filter_interactions(odd, labels.limit(0)))
    for name in ("class", "mask", "b0", "length", "copy", "first_id", "n", "part", "good", "toxic", "step"):
        odd = odd.withColumn(name, F.lit("x"))
    assert got(filter_audit.filter_interactions(odd, labels.limit(0).withColumn("part", F.lit(1)))) == plain
    assert all(v[4] == v[5] == 0 for v in plain.values())


def test_shapley_sums_to_all_removals(table):
    docs, labels = table
    total = defaultdict(int)
    for (part, order, step), v in got(filter_audit.filter_interactions(docs, labels)).items():
        if order == "ABCDE":
            total[part] += v[6] - 120 * v[1]
    assert set(total.values()) == {0}
