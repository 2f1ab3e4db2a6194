"""Keyed grouping and the two-sided join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmatch.functions.geometry import call


def group_by_key(features: DataFrame, by: tuple[str, ...] = ("area", "key"), union: bool = True) -> DataFrame:
    """One row per key: the union of its geometries, feature ids in order (of rows with a geometry), first properties.

    features: by.., seq (input order), geom (WKB or null), feature_id, props. Null and blank keys go. The union
    is taken in sixteen parts of a key first, so that a hot key's polygons are not one task's work.
    """
    kept = features.where(F.col(by[-1]).isNotNull() & (F.col(by[-1]) != ""))
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("geom").isNotNull(), F.struct("seq", "feature_id")))), lambda x: x.feature_id))
    rows = kept.groupBy(*by).agg(ids.alias("feature_ids"), F.min_by("props", "seq").alias("props"))
    if not union:
        return rows
    parts = kept.where("geom is not null").groupBy(*by, F.pmod(F.xxhash64("seq"), F.lit(16)).alias("_salt")).agg(call("UnionAll", F.collect_list("geom")).alias("geom"))
    whole = parts.groupBy(*by).agg(call("UnionAll", F.collect_list("geom")).alias("geom"))
    return rows.join(whole, list(by), "left")


def first_wins(rows: DataFrame, by: list[str], value: str, order: str, where: Column | None = None) -> DataFrame:
    """Value of the first row, by an explicit order, that qualifies; one row per group that has any."""
    kept = rows if where is None else rows.where(where)
    return kept.groupBy(*by).agg(F.min_by(value, order).alias(value))


def full_outer(official: DataFrame, osm: DataFrame, by: list[str], geometry: str = "geom", carry: list[str] | None = None) -> DataFrame:
    """All keys of either side with both geometries, the category and the official side's columns ``carry``.

    A key is matched only where both geometries are there; a key of the official side is official_only otherwise.
    """
    left = official.select(*by, *(carry or []), F.col(geometry).alias("official_geom"), F.lit(True).alias("_official"))
    right = osm.select(*by, F.col(geometry).alias("osm_geom"))
    category = (
        F.when(F.col("official_geom").isNotNull() & F.col("osm_geom").isNotNull(), "matched")
        .when(F.col("_official"), "official_only")
        .otherwise("unmatched_osm")
    )
    return left.join(right, by, "full_outer").withColumn("category", category).drop("_official")


def latest_over_obsolete(latest: DataFrame, obsolete: DataFrame, by: list[str]) -> DataFrame:
    """Entries of both, the latest one where a key is in either; last_year says how long an obsolete one was listed."""
    both = latest.select(*by, F.col("name").alias("_new"), F.lit(1).alias("_has")).join(obsolete.select(*by, F.col("name").alias("_old"), "last_year"), by, "full_outer")
    return both.select(*by, F.when(F.col("_has") == 1, F.col("_new")).otherwise(F.col("_old")).alias("name"), F.when(F.col("_has").isNull(), F.col("last_year")).alias("last_year"))


def without_ids(rows: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """Rows whose id is not listed; rows without an id stay."""
    return rows.where(~F.coalesce(F.col(column).isin(ids), F.lit(False))) if ids else rows


def with_levels(rows: DataFrame, column: str, levels: list[str] | None) -> DataFrame:
    """Rows of the listed levels; rows without a level go once there is a list."""
    return rows.where(F.col(column).isin(levels)) if levels else rows


def stem_suffixes(rows: DataFrame, stem: str, order: str) -> DataFrame:
    """Adds file_name: the first of equal stems as it is, then _2, _3 and so on."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(stem).orderBy(order))
    return rows.withColumn("file_name", F.when(n == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("_"), n.cast("string"))))
