"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import ENTRY_DIR, REGISTERED, entry, oracle_sql, queries
from check_oracles import TABLES, rows_of


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{ENTRY_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert {query.__name__ for query in REGISTERED} <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [query.__name__ for query in REGISTERED])
def test_query_matches_sql(spark, duck, name):
    frame = queries()[name](spark, ENTRY_DIR)
    relation = duck.sql(oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    found = rows_of(frame.columns, frame.collect())
    assert found == rows_of(relation.columns, relation.fetchall())


def test_entry(spark):
    assert entry(spark).columns == ["query_id", "prompt", "n_sources"]
