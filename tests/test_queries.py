"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return (t.tz_convert("UTC").tz_localize(None) if t.tz else t).isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def test_names():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
