"""Every query with SQL gives the SQL's rows on the smallest tables."""

import collections
import datetime
from pathlib import Path

import duckdb
import pytest

from warraq.plans import problems, reference

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat().replace("+00:00", "")
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_query_equals_sql(spark, con, name):
    df = reference.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = collections.Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = con.execute(reference.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == collections.Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted({*reference.QUERIES, *problems.QUERIES} - {*reference.SQL}))
def test_query_without_sql_runs(spark, name):
    q = reference.QUERIES | problems.QUERIES
    assert q[name](spark, str(DATA)).count() > 0
