"""Queries that return every row of their tables."""

from __future__ import annotations

import duckdb

from landmatch.plans.registry import ORACLES, QUERIES


def test_sort_places_every_row(spark, small):
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "n_chars").collect()}
    rows = sorted(QUERIES["table_sort_nulls_last"](spark, small).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, len(docs) + 1))
    assert [r.doc_id for r in rows] == sorted(docs, key=lambda k: (docs[k] is None, -(docs[k] or 0), k))


def test_candidates_take_every_row(spark, small):
    customers = {r.c_custkey for r in spark.read.parquet(f"{small}/customer.parquet").collect()}
    assert {int(r.key) for r in QUERIES["candidates_in_shrunk_rect"](spark, small).collect()} == customers


def test_candidates_of_keys_that_rows_share(spark, tmp_path):
    """Keys of more than five digits are cut, so rows share them: one result per key, as the SQL gives, hits repeated."""
    con = duckdb.connect()
    for name, sql in {
        "customer": "SELECT CAST(k AS BIGINT) AS c_custkey, 'A' AS c_mktsegment FROM (SELECT unnest([5, 12345, 123450, 123455, 123456, 123451, 60, 105, 999990]) AS k)",
        "supplier": "SELECT CAST(k AS BIGINT) AS s_suppkey FROM range(0, 60000) r(k) WHERE k < 300 OR k BETWEEN 4100 AND 4130 OR k BETWEEN 41100 AND 41200",
        "part": "SELECT CAST(k AS BIGINT) AS p_partkey, ' n ' || k AS p_name, CAST(k % 50 AS INTEGER) AS p_size FROM range(0, 60000) r(k) WHERE k < 300 OR k BETWEEN 4100 AND 4130 OR k BETWEEN 41100 AND 41200",
    }.items():
        con.execute(f"CREATE TABLE {name} AS {sql}")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    for name in ("candidates_in_shrunk_rect", "candidates_in_polygons"):
        wanted = sorted(con.execute(f"SELECT g, key, candidates FROM ({ORACLES[name]})").fetchall())
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(tuple(r) for r in got.select("g", "key", "candidates").collect()) == wanted
        assert len(wanted) == 6
