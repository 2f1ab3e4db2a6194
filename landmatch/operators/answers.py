"""Features out of the answers of feature services, and polygons out of map relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmatch.functions.geometry import call
from landmatch.functions.web import wfs_exception
from landmatch.sources.readers import polygon_text

#: Fixed value: what an answer that is neither JSON nor XML is called.
INVALID = "INVALID_WFS_XML"
COLLECTION = "features array<struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
FEATURES = "array<struct<id:string,properties:map<string,string>,geom:binary>>"


def json_features(text: Column) -> Column:
    """The features of a GeoJSON collection; null for anything else."""
    found = F.filter(F.from_json(text, COLLECTION).features, lambda f: f.type == "Feature")
    shape = lambda f: call("FromText", polygon_text(f.geometry.type, f.geometry.coordinates))
    return F.transform(found, lambda f: F.struct(f.id.alias("id"), f.properties.alias("properties"), shape(f).alias("geom")))


def features(answers: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep.., error, id, properties, geom): one row per feature of an answer, or one with its error.

    An answer is GeoJSON, or XML with members; an exception report gives its text as the error. An answer without
    features, or a null one, gives no row.
    """
    told = F.coalesce(F.col(text), F.lit(""))
    by_json = answers.select(*keep, told.alias("_text"), json_features(told).alias("_json"))
    read = by_json.withColumn("_xml", F.when(F.col("_json").isNull(), call("XmlFeatures", "_text")))
    error = F.when(F.col("_json").isNull(), F.when(F.col("_xml").isNull(), F.lit(INVALID)).otherwise(wfs_exception(F.col("_text"))))
    checked = read.withColumn("error", F.when(F.col("_text") != "", error)).withColumn("_f", F.coalesce(F.col("_json").cast(FEATURES), F.col("_xml").cast(FEATURES)))
    each = checked.select(*keep, "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("_f"))).alias("f"))
    return each.where("error is not null or f is not null").select(*keep, "error", "f.id", "f.properties", "f.geom")


def relation_polygons(members: DataFrame, relation: str = "relation_id") -> DataFrame:
    """(relation, geom): the polygons of each relation from its member ways (relation, role, geom as WKB); null where no ring closes."""
    grouped = members.groupBy(relation).agg(F.collect_list(F.struct("role", "geom")).alias("_members"))
    return grouped.select(relation, call("RelationPolygons", "_members").alias("geom"))
