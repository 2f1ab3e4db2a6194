"""Every registered query against its SQL twin in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from landmatch.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    same = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted(([same(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    assert got, name
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, found.fetchall())
