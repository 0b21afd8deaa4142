"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sparkveil.plans import queries

NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for x in os.listdir(sf):
        path = f"{sf}/{x}"
        c.execute(f"create view {x.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(frame, columns):
    def one(x):
        if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x:
            return "-"
        return str(x) if isinstance(x, (str, bool)) or type(x).__name__ in ("bool", "bool_") else str(round(float(x), 6))

    return sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = queries.queries()[name](spark, sf).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
