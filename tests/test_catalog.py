"""Every registered query against the SQL that checks it."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from folio.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = queries()[name](spark, FOLDER)
    got = comparable(df.columns, df.collect())
    assert got
    answer = database.execute(oracle_sql()[name])
    columns = [column[0] for column in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == comparable(columns, answer.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 20
