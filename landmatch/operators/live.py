"""Live rows: keys by source, with features that have no id numbered inside their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmatch.functions.web import row_key
from landmatch.plans.base import shared


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with their place (long, from 1) in their group, by the order's columns ascending; no task holds a group.

    Ranges of (by, order) are numbered on their own and moved by what the group has in the ranges before. The ranges
    are cut from their lineage, so that a lost executor cannot deal them anew. Nulls are a group and come first in the
    order; rows that are equal in by and order have their places among one another by chance.
    """
    at = shared(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    parts = at.groupBy("_part", by).agg(F.count("*").alias("_in"))
    # a group has as many rows here as ranges that it touches
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("_part").alias("_p"), F.col(by).alias("_by"), F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
    inside = at.withColumn("_n", F.row_number().over(Window.partitionBy("_part", by).orderBy(*order)))
    joined = inside.join(bases, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(*rows.columns, (F.col("_base") + F.col("_n")).alias(name))


def row_keys(features: DataFrame, source: str, ident: str, order: list[str], kind: Column) -> DataFrame:
    """features with row_key; one without an id is known by its place among all features of its source."""
    return numbered(features, source, order, "_index").withColumn("row_key", row_key(kind, F.col(source), F.col(ident), F.col("_index"))).drop("_index")
