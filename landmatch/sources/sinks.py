"""Sinks. Spark's committer makes a folder appear whole; upserts are computed first and swapped in by the caller's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmatch.operators.history import upsert_snapshots


def write_comparison(rows: DataFrame, path: str, buckets: int = 32) -> None:
    """All rows, partitioned by area and a bucket of the key: a point lookup reads one small folder, and files stay few."""
    keyed = rows.withColumn("key_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    keyed.repartition("area", "key_bucket").write.mode("overwrite").partitionBy("area", "key_bucket").parquet(path)


def lookup(stored: DataFrame, area: str, key: str, buckets: int = 32) -> DataFrame:
    """One row of what write_comparison wrote; only its bucket is read."""
    bucket = stored.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(buckets)).alias("b")).first()["b"]
    return stored.where((F.col("area") == area) & (F.col("key_bucket") == bucket) & (F.col("key") == key))


def feature_json(geometry_json: Column, properties: Column) -> Column:
    """A GeoJSON feature; null properties are left out."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.from_json(geometry_json, "struct<type:string,coordinates:string>").alias("geometry"), properties.alias("properties")))


def provenance(prefix: str, source: Column) -> Column:
    """A source's entries under a prefix; blank ones go."""
    filled = F.map_filter(source, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return F.transform_keys(filled, lambda k, v: F.concat(F.lit(f"{prefix}."), k))


def write_lines(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(path)


def write_snapshots(old: DataFrame, new: DataFrame, path: str) -> None:
    """The upserted history, sorted by run inside each area, in a folder of its own."""
    upsert_snapshots(old, new, ["area", "run_id"]).repartition("area").sortWithinPartitions("area", "run_id").write.partitionBy("area").parquet(path)


def merged_metadata(base: DataFrame, patch: DataFrame, by: list[str]) -> DataFrame:
    """base with the patch's values where it has one; rows of either side stay."""
    values = [c for c in base.columns if c not in by]
    renamed = patch.select(*by, *[F.col(c).alias(f"_{c}") for c in values])
    return base.join(renamed, by, "full_outer").select(*by, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def write_documents(rows: DataFrame, path: str, key: str, document: str, buckets: int = 32) -> None:
    """One JSON document per key, as lines in buckets of the key: an index or dictionary too large for one file.

    A key must be there once and its document must be JSON; otherwise nothing is written.
    """
    keyed = rows.select(F.col(key).cast("string").alias("key"), F.col(document).alias("document"))
    broken = keyed.where(F.col("key").isNull() | F.get_json_object("document", "$").isNull()).select("key").limit(1).collect()
    twice = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").limit(1).collect()
    if broken or twice:
        raise ValueError(f"{'no document for' if broken else 'two documents for'} key {(broken or twice)[0]['key']!r}")
    spread = keyed.withColumn("key_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    spread.repartition("key_bucket").sortWithinPartitions("key_bucket", "key").write.mode("overwrite").partitionBy("key_bucket").json(path)
