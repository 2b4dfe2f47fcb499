"""Every library query with SQL gives the oracle's rows on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import displace.queries  # noqa: F401
from displace import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events labels documents".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v) + 0.0:.4f}"
    except (TypeError, ValueError):
        return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def _close(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 2e-4 * max(1.0, abs(float(b)) * 1e-3)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(registry.ORACLE[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert all(all(map(_close, a, b)) for a, b in zip(got[1], want[1], strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.count()
