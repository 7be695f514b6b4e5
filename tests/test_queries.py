"""Every registered query against its SQL twin, and the entry points."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, rows_of

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    frame = QUERIES[name](spark, small)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        assert got
        return
    answer = duck.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows_of(columns, answer.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 14


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
