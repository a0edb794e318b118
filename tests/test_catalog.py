"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corploom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in records])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, result.fetchall())
