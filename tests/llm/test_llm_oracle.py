"""Registered queries against their DuckDB SQL."""

import duckdb
import pytest

from cellpulse.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    expected = con.sql(queries.ORACLE[name])
    columns = expected.columns
    got = queries.REGISTRY[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    # Nulls sort too.
    key = lambda row: [(value is None, value) for value in row]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(expected.fetchall(), key=key)
