"""The corpus queries that have an SQL twin, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from landmatch.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, small)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))
