"""Sources: GeoJSON features, registers (fixed width, workbook, archive members), event logs, payloads, area configs."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions.dates import named_date
from landmatch.functions.geometry import call

EVENT_SCHEMA = "kind string, runId string, at string, step string, dataset string, status string, reason string, durationMs bigint, exitCode int"
#: Fixed widths of a register line: name, first character (from 1), length.
REGISTER = (("satzart", 1, 2), ("snapshot_date", 3, 8), ("land", 11, 2), ("rb", 13, 1), ("kreis", 14, 2), ("gem", 16, 3), ("vb", 19, 4), ("name", 23, 50))
METRICS_SCHEMA = "struct<iou:double,areaDiffPct:double,symmetricDiffPct:double,hausdorffM:double,hausdorffP95M:double,hausdorffNorm:double,officialAreaM2:double,osmAreaM2:double>"
TABLE_SCHEMA = f"area string, rows array<struct<canonicalMatchKey:string,category:string,nameLabel:string,osmRelationId:string,metrics:{METRICS_SCHEMA}>>"
GEOJSON_SCHEMA = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>,id:string>>"


def polygon_text(kind: Column, coordinates: Column) -> Column:
    """WKT of a GeoJSON polygon, multipolygon or point (coordinates as JSON); other kinds are null."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", "), F.lit(")"))
    polygon = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    at = F.from_json(coordinates, "array<double>")
    point = F.concat(F.lit("POINT ("), F.get(at, F.lit(0)).cast("string"), F.lit(" "), F.get(at, F.lit(1)).cast("string"), F.lit(")"))
    return F.when(kind == "Point", point).when(kind == "Polygon", F.concat(F.lit("POLYGON "), polygon(one))).when(kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(many, polygon), ", "), F.lit(")")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(seq, feature_id, props, geom): features in the file's order. A collection is one JSON document per file."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", GEOJSON_SCHEMA).alias("c"))
    rows = text.select(F.posexplode("c.features").alias("seq", "f"))
    return rows.select(F.col("seq").cast("long").alias("seq"), F.col("f.id").alias("feature_id"), F.col("f.properties").alias("props"), call("FromText", polygon_text(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))).alias("geom"))


def register_fields(value: Column) -> list[Column]:
    return [F.substring(value, at, n).alias(name) for name, at, n in REGISTER]


def read_register_text(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width register lines, numbered from 1 after blank lines are left out; UTF-8, or Latin-1 where that fails."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    utf8 = F.decode("content", "UTF-8")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = raw.select("path", F.when(valid, utf8).otherwise(F.decode("content", "ISO-8859-1")).alias("t"))
    lines = F.filter(F.split("t", "\r?\n"), lambda x: F.trim(x) != "")
    return text.select(F.posexplode(lines).alias("p", "value")).select((F.col("p") + 1).cast("long").alias("line"), *register_fields(F.col("value")))


def read_workbook(spark: SparkSession, path: str, sheet: str, first_row: int = 7) -> DataFrame:
    """(line, a, c..h, sheet, snapshot): rows from first_row on whose first cell is a number, of the sheet whose name matches; one small workbook per file.

    snapshot is the date in the pattern's first group (DDMMYYYY), null without one. A workbook without such a sheet is an error.
    """
    columns = ["a", "c", "d", "e", "f", "g", "h", "sheet"]

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(list(sheet_rows(content, sheet, first_row)), columns=["line", *columns])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "line long, " + ", ".join(f"{c} string" for c in columns))
    return rows.withColumn("snapshot", _dated(F.col("sheet"), sheet))


def _dated(name: Column, pattern: str) -> Column:
    return named_date(name, pattern) if re.compile(pattern).groups else F.lit(None).cast("date")


def sheet_rows(content: bytes, sheet: str, first_row: int) -> Iterator[tuple]:
    from xml.etree import ElementTree as X

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        plain = lambda e: {k.rsplit("}", 1)[-1]: v for k, v in e.items()}
        inside = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in inside:
            shared = ["".join(t.text or "" for t in s.iter() if tag(t) == "t") for s in X.fromstring(z.read("xl/sharedStrings.xml")) if tag(s) == "si"]
        sheets = [e for e in X.fromstring(z.read("xl/workbook.xml")).iter() if tag(e) == "sheet"]
        at = next((k for k, e in enumerate(sheets) if re.search(sheet, e.get("name"))), None)
        if at is None:
            raise ValueError(f"no sheet matches {sheet}; there are {[e.get('name') for e in sheets]}")
        # the workbook's relations name a sheet's file; without them files count as the sheets do
        targets = {}
        if "xl/_rels/workbook.xml.rels" in inside:
            targets = {e.get("Id"): e.get("Target") for e in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets.get(plain(sheets[at]).get("id"), f"worksheets/sheet{at + 1}.xml")
        file = target[1:] if target.startswith("/") else f"xl/{target}"
        for row in X.fromstring(z.read(file)).iter():
            if tag(row) != "row" or int(row.get("r", 0)) < first_row:
                continue
            found = {}
            for c in row:
                value = "".join(e.text or "" for e in c.iter() if tag(e) in ("v", "t"))
                found[re.sub("[0-9]", "", c.get("r", "")).lower()] = (shared[int(value)] if c.get("t") == "s" and value else value).strip()
            if re.fullmatch("[0-9]+", found.get("a") or ""):
                yield (int(row.get("r")), *(found.get(k) for k in ("a", "c", "d", "e", "f", "g", "h")), sheets[at].get("name"))


def read_archive_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, content, snapshot) of the members whose name matches; snapshot is the date in the pattern's first group (DDMMYYYY or DDMMYY), null without one."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    got = [(name, m, z.read(m)) for m in z.namelist() if re.search(pattern, m)]
                yield pd.DataFrame(got, columns=["archive", "member", "content"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, content binary")
    return found.withColumn("snapshot", _dated(F.col("member"), pattern))


def parse_events(lines: DataFrame, strict: bool = False, column: str = "value") -> DataFrame:
    """Events of JSON lines: bad lines and those without a kind are left out, or with strict raise; blank lines never count."""
    e = F.from_json(F.col(column), EVENT_SCHEMA, {"mode": "FAILFAST"} if strict else {})
    full = lines.where(F.trim(column) != "").withColumn("_e", e)
    if strict:
        full = full.withColumn("_e", F.when(F.col("_e.kind").isNull(), F.raise_error(F.lit("an event has no kind"))).otherwise(F.col("_e")))
    return full.where("_e.kind is not null").select(*[c for c in lines.columns if c != column], "_e.*")


def canonical_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Strictly parsed lines written again, one compact object each."""
    return parse_events(lines, strict=True, column=column).select(F.to_json(F.struct("*")).alias(column))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, area, row): comparison tables of all areas; malformed ones are left out."""
    whole = spark.read.option("mode", "DROPMALFORMED").option("multiLine", True).schema(TABLE_SCHEMA).json(path)
    return whole.select(F.input_file_name().alias("file"), "area", F.explode("rows").alias("row")).where("area is not null")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of every file below; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


@dataclass(frozen=True)
class AreaConfig:
    """One area's settings; see ``parse_config`` for the rules between them."""

    area: str
    id_preset: str
    osm_profile: str
    match_property: str
    bbox_filter: str = "none"
    bbox_buffer_degrees: float | None = None
    scope_filter: str = "none"
    ignore_relation_ids: tuple[str, ...] = ()
    admin_levels: tuple[str, ...] = ()
    select: tuple[str, ...] = field(default_factory=tuple)


#: Older names of settings that are still read.
ALIASES = {"centroid_in_official_coverage": "intersects_official_coverage"}


def parse_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas; strings are left alone."""
    keep = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = keep.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    closing = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)
    return json.loads(closing.sub(lambda m: m[0] if m[0][0] == '"' else "", bare))


def parse_config(area: str, text: str) -> AreaConfig:
    """Raises on unknown settings, and unless a buffer is given exactly where the bounding box filter is on."""
    raw = parse_jsonc(text)
    known = set(AreaConfig.__dataclass_fields__) - {"area"}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    values["scope_filter"] = ALIASES.get(values.get("scope_filter", "none"), values.get("scope_filter", "none"))
    config = AreaConfig(area=area, **values)
    if (config.bbox_filter == "official_bbox_overlap") != (config.bbox_buffer_degrees is not None):
        raise ValueError("a buffer belongs to the bounding box filter")
    return config


def read_candidate_points(spark: SparkSession, path: str) -> DataFrame:
    """Candidate points as GeoJSON features; a path that is not there has none, and what is no point is left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "feature_id string, props map<string,string>, geom binary")
    points = read_geojson(spark, path)
    return points.where(call("AsText", F.col("geom")).startswith("POINT")).select("feature_id", "props", "geom")


def areas_below(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path, sorted; hidden ones and files are left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().getName() for f in found if f.isDirectory() and not f.getPath().getName().startswith("."))


def merged_extract(configs: list[AreaConfig]) -> dict[str, list[str]]:
    """What one shared extract must hold for all areas."""
    return {name: sorted({x for c in configs for x in getattr(c, name)}) for name in ("select", "ignore_relation_ids", "admin_levels")}
