"""Which areas list a relation, and where a request for it should lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relation_index(rows: DataFrame) -> DataFrame:
    """(relation_id, candidates): distinct places of each relation, sorted. rows: relation_id, dataset, area_id, feature_key, feature_name."""
    place = F.struct("dataset", "area_id", "feature_key", "feature_name")
    return rows.where("relation_id is not null").groupBy("relation_id").agg(F.array_sort(F.collect_set(place)).alias("candidates"))


def decision(candidates: Column, dataset: Column) -> Column:
    """(kind, target): redirect where one candidate is left, of the data set if one is asked for; else list or not_found."""
    wanted = F.nullif(F.trim(F.coalesce(dataset, F.lit(""))), F.lit(""))
    fitting = F.when(wanted.isNull(), candidates).otherwise(F.filter(candidates, lambda c: c["dataset"] == wanted))
    kind = F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, "not_found").when(F.size(fitting) == 1, "redirect").otherwise("list")
    return F.struct(kind.alias("kind"), F.when(kind == "redirect", F.get(fitting, F.lit(0))).alias("target"))


def first_found(rows: DataFrame, by: list[str], priority: str) -> DataFrame:
    """The row of the smallest priority per key, as a lookup in the main table before the others."""
    value = F.struct(*[c for c in rows.columns if c not in by])
    return rows.groupBy(*by).agg(F.min_by(value, priority).alias("v")).select(*by, "v.*")


def click_decision(hits: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by.., action, first_key): what a click on features (by.., feature_key, category) does, in draw order.

    The first one drawn is opened, unless an official-only and an unmatched one lie there together: then the user chooses.
    """
    several = F.count_distinct("feature_key") > 1
    both = F.bool_or(F.col("category") == "official_only") & F.bool_or(F.col("category") == "unmatched_osm")
    return hits.groupBy(*by).agg(F.when(several & both, "choose").otherwise("open").alias("action"), F.min_by("feature_key", order).alias("first_key"))
