"""Every registered query against its SQL on the given tables."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, spark_rows, sql_rows
from docledger.plans.oracles import ORACLES
from docledger.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    columns, rows = spark_rows(entry_points.queries()[name](spark, SF))
    sql_columns, expected = sql_rows(db, SQL[name])
    assert columns == sql_columns
    assert len(rows) == len(expected)
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    assert wrong[:3] == []


def test_entry(spark):
    row = entry_points.entry(spark).first()
    assert row.total_scanned == 1500
    assert row.total_scanned == sum(row[1:])
