"""Every query with an oracle gives the oracle's rows."""

import math

import duckdb
import pytest

import plumage.plans.more  # noqa: F401
from plumage.plans.queries import ORACLES, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(got_cols, got, want_cols, want):
    assert sorted(got_cols) == sorted(want_cols)
    order = sorted(got_cols)
    a = sorted((tuple(r[got_cols.index(c)] for c in order) for r in got), key=str)
    b = sorted((tuple(r[want_cols.index(c)] for c in order) for r in want), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            same = u == v or (isinstance(u, float) and isinstance(v, (int, float)) and (math.isclose(u, v, abs_tol=2e-6) or u != u and v != v))
            assert same, (x, y)
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    df = QUERIES[name](spark, small)
    compare(df.columns, [tuple(r) for r in df.collect()], want_cols, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
