"""Every panel query against its SQL in DuckDB; the others give rows of a stable schema."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest

from crosspanel import catalogue as queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return None if isinstance(v, float) and math.isnan(v) else v


def by_key(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, round(v, 3) if isinstance(v, float) else v) if not isinstance(v, (datetime.date, bool)) else (True, str(v)) for v in r if not isinstance(v, float)) + tuple((v is not None, v or 0.0) for v in r if isinstance(v, float)))


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4))
    return a == b


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    out = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in out.collect()]
    if name not in queries.ORACLES:
        assert rows and len(set(out.columns)) == len(out.columns)
        return
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(out.columns)
    want, got = by_key(names, found.fetchall()), by_key(out.columns, rows)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not wrong, (len(wrong), wrong[:3])
