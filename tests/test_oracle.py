"""Every query that has SQL, against DuckDB on the smallest tables; every other one for a stable schema."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(small + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if type(value).__name__ in ("float", "Decimal"):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    found = con.execute(SQL[name])
    own = [c[0] for c in found.description]
    assert sorted(own) == names
    want = sorted((tuple(plain(dict(zip(own, r))[c]) for c in names) for r in found.fetchall()), key=str)
    assert [tuple(str(x) for x in r) for r in got] == [tuple(str(x) for x in r) for r in want]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len({c.lower() for c in df.columns})
    df.write.format("noop").mode("overwrite").save()


def test_no_sql_without_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "vector_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
