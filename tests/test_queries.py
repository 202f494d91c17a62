"""Every query with SQL against an independent engine; the others give rows."""

import datetime
from pathlib import Path

import duckdb
import pytest

from lumenreel import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    q = duck.execute(catalog.ORACLE_SQL[name])
    cols = [c[0] for c in q.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    assert got == sorted(repr(tuple(plain(r[k]) for k in at)) for r in q.fetchall())


def test_oracles_belong_to_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
