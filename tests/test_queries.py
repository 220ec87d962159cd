"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from recordloom.plans import catalog, records

QUERIES, ORACLE_SQL = catalog.QUERIES | records.QUERIES, catalog.ORACLE_SQL | records.ORACLE_SQL
SF = "/root/testdata/sf0.001"


def text(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, (float, np.floating)):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(text(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
