"""Every geometric query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from pointfield.plans import catalog

from .conftest import SF

#: Runs many rounds; checked by the driver's comparison instead.
SLOW = {"k06_trace_sphere_field"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return c


def shaped(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert shaped(map(tuple, df.collect()), df.columns) == shaped(want.fetchall(), names)
