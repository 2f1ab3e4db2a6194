"""Where queries register themselves, and the keyed rectangles that several of them start from."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions import keys

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL twin if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """df cut from its lineage by files in the folder of spark.checkpoint.dir; only a local session, which is one process, may go without."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle per customer; every eleventh has none. Columns key, area, seq, has, x0, y0, x1, y1."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        keys.official_key(k, "plz-5").alias("key"), F.col("c_mktsegment").alias("area"), k.alias("seq"), (k % 11 != 0).alias("has"),
        (k % 97).cast("double").alias("x0"), (k % 71).cast("double").alias("y0"), (k % 97 + 10 + k % 7).cast("double").alias("x1"), (k % 71 + 10 + k % 5).cast("double").alias("y1"),
    )


OFFICIAL_SQL = """official AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS key, c_mktsegment AS area, c_custkey AS seq, c_custkey % 11 <> 0 AS has,
    CAST(c_custkey % 97 AS DOUBLE) AS x0, CAST(c_custkey % 71 AS DOUBLE) AS y0,
    CAST(c_custkey % 97 + 10 + c_custkey % 7 AS DOUBLE) AS x1, CAST(c_custkey % 71 + 10 + c_custkey % 5 AS DOUBLE) AS y1
  FROM customer)"""


def osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle per order, near that of its customer. Columns key, seq, level, x0, y0, x1, y1."""
    k, n = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        keys.osm_key(k, "plz-5").alias("key"), n.alias("seq"), F.substring("o_orderpriority", 1, 1).alias("level"),
        (k % 97 + n % 3).cast("double").alias("x0"), (k % 71 - n % 2).cast("double").alias("y0"), (k % 97 + 10 + n % 4).cast("double").alias("x1"), (k % 71 + 9 + n % 5).cast("double").alias("y1"),
    )


OSM_SQL = """osm AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS key, o_orderkey AS seq, substr(o_orderpriority, 1, 1) AS level,
    CAST(o_custkey % 97 + o_orderkey % 3 AS DOUBLE) AS x0, CAST(o_custkey % 71 - o_orderkey % 2 AS DOUBLE) AS y0,
    CAST(o_custkey % 97 + 10 + o_orderkey % 4 AS DOUBLE) AS x1, CAST(o_custkey % 71 + 9 + o_orderkey % 5 AS DOUBLE) AS y1
  FROM orders)"""
