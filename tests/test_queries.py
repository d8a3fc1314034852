"""Every registered query against its DuckDB counterpart on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.sources import TABLES

DIR = "/root/testdata/sf0.001"
#: Queries whose methods need more documents, or that run long, have tests of their own.
NAMES = sorted(n for n in entry.queries() if not re.match(r"op[0-9]+_", n) and n not in ("pipeline", "edit_near_documents"))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    frame = entry.queries()[name](spark, DIR)
    got = rows_of(frame.columns, frame.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[0]
    else:
        want = oracle.sql(sql)
        assert got == rows_of(want.columns, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
