"""What the home page knows of all areas, from their comparison tables: counts, sources, licences.

A comparison table is one JSON document per area. One that is no JSON, lacks a part that the report needs or holds an
unknown category or level counts as malformed and is left out without an error; the other areas stay. JSON numbers
are taken where a text is asked, and a part that is null counts as one that is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions import keys, provenance
from landmatch.operators.dictionary import key_order
from landmatch.operators.report import CATEGORIES, LEVELS

# Numbers that metrics must have, texts that a row and a table must have, and verdicts on a licence.
NUMBERS = ("iou", "areaDiffPct", "symmetricDiffPct", "hausdorffM", "officialAreaM2", "osmAreaM2")
ROW_TEXTS = ("canonicalMatchKey", "nameLabel", "osmRelationId")
TABLE_TEXTS = ("area", "displayName", "titlePrefix", "generatedAt", "metricsCrs", "tippecanoeLayer")
COMPATIBLE = ("unknown", "no", "yes_licence", "yes_waiver")
SOURCE = ("provider", "dataset", "layer", "sourcePublicUrl", "sourceDownloadUrl", "licenseLabel", "licenseSourceUrl", "osmCompatibility", "osmCompatibilitySourceUrl", "osmCompatibilityComment")
#: Addresses that a source must have, and those that it may have; all are absolute.
ADDRESSES, MORE_ADDRESSES = ("sourcePublicUrl", "sourceDownloadUrl"), ("licenseSourceUrl", "osmCompatibilitySourceUrl")


def _texts(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n}: string" for n in names)


METRICS = f"struct<{', '.join(f'{n}: double' for n in NUMBERS)}, issueIndicator: struct<level: string>>"
TABLE = (
    f"struct<{_texts(TABLE_TEXTS)}, hasPmtiles: boolean, filterConfigSummary: struct<officialMatchProperty: string>, "
    f"sourceMetadata: struct<official: struct<{_texts(SOURCE)}>>, rows: array<struct<{_texts(ROW_TEXTS)}, category: string, metrics: {METRICS}>>, "
    f"unmatchedOsm: array<struct<{_texts(ROW_TEXTS)}>>>"
)


def _there(item: Column, names: tuple[str, ...]) -> Column:
    held = F.lit(True)
    for name in names:
        held = held & item[name].isNotNull()
    return held


def _sound(t: Column) -> Column:
    """Whether a table is one the report can show; false where it is null."""

    def row(r: Column) -> Column:
        level = r["metrics"]["issueIndicator"]
        measured = r["metrics"].isNull() | (_there(r["metrics"], NUMBERS) & (level.isNull() | F.coalesce(level["level"].isin(*LEVELS), F.lit(False))))
        return _there(r, ROW_TEXTS) & F.coalesce(r["category"].isin(*CATEGORIES[:2]), F.lit(False)) & measured

    source = t["sourceMetadata"]["official"]
    absolute = lambda name: F.try_parse_url(F.trim(source[name]), F.lit("HOST")).isNotNull()
    known = F.coalesce(source["osmCompatibility"].isin(*COMPATIBLE), F.lit(True))
    for name in ADDRESSES:
        known = known & absolute(name)
    for name in MORE_ADDRESSES:
        known = known & (provenance.filled(source[name]).isNull() | absolute(name))
    parts = _there(t, (*TABLE_TEXTS, "hasPmtiles", "filterConfigSummary", "rows", "unmatchedOsm")) & known
    named = (F.trim(t["displayName"]) != "") & (F.trim(t["titlePrefix"]) != "")
    return F.coalesce(parts & named & F.forall(t["rows"], row) & F.forall(t["unmatchedOsm"], lambda r: _there(r, ROW_TEXTS)), F.lit(False))


def comparison_tables(documents: DataFrame, area: str = "area", text: str = "text") -> DataFrame:
    """(area, table): the sound tables among documents (area, text); the area is the folder's name, whatever the document says."""
    # a row of its own, so that neither the test nor what reads the table parses the text again
    return documents.where(F.col(area).isNotNull()).select(F.col(area).alias("area"), F.explode(F.filter(F.array(F.from_json(F.col(text), TABLE)), _sound)).alias("table"))


def read_comparison_tables(spark: SparkSession, path: str) -> DataFrame:
    """(area, table) of the folders below a path: ``<area>/output/comparison_table.json``; areas without the file and hidden folders have none."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "comparison_table.json").option("recursiveFileLookup", True).text(path)
    place = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/output/comparison_table\.json$", 1)
    found = files.select(F.try_url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))).alias("area"), F.col("value").alias("text"))
    return comparison_tables(found.where((F.col("area") != "") & ~F.col("area").startswith(".")))


def home_summaries(tables: DataFrame) -> DataFrame:
    """(area, display_name, matched, official_only, unmatched_osm, reviews, issues), without a shuffle."""
    t = F.col("table")
    count = lambda part, value: F.size(F.filter(t["rows"], lambda r: part(r) == value)).cast("long")
    category, level = (lambda r: r["category"]), (lambda r: r["metrics"]["issueIndicator"]["level"])
    return tables.select(
        "area", F.trim(t["displayName"]).alias("display_name"), count(category, "matched").alias("matched"), count(category, "official_only").alias("official_only"),
        F.size(t["unmatchedOsm"]).cast("long").alias("unmatched_osm"), count(level, "review").alias("reviews"), count(level, "issue").alias("issues"),
    )


def home_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """The counts of home_summaries from rows (by.., category, level) as they are stored, all three categories among them."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    main = F.col("category") != "unmatched_osm"
    level = lambda v: F.count_if(main & (F.col("level") == v))
    return rows.groupBy(*by).agg(n("category", "matched").alias("matched"), n("category", "official_only").alias("official_only"), n("category", "unmatched_osm").alias("unmatched_osm"), level("review").alias("reviews"), level("issue").alias("issues"))


def match_rules(summaries: DataFrame, configs: DataFrame) -> DataFrame:
    """summaries with match_properties and admin_levels of the areas' settings (area, profile, match_property, admin_levels).

    The profile ``admin_rs`` has one fixed property; areas whose settings cannot be read, and empty lists, have none.
    """
    properties = F.array(F.when(F.col("profile") == "admin_rs", "de:regionalschluessel").otherwise(F.col("match_property")))
    known = configs.select("area", properties.alias("match_properties"), F.when(F.size("admin_levels") > 0, F.col("admin_levels")).alias("admin_levels"))
    return summaries.join(known, "area", "left")


def licence_summaries(tables: DataFrame, configs: DataFrame) -> DataFrame:
    """(area, display_name, group_key, label, source_url, compatible, compatible_url, comment, merge_key) of every table.

    configs: (area, mode, profile); without one an area is grouped by its download address. A missing label or verdict
    is ``unknown``; empty texts are null.
    """
    o = F.col("table.sourceMetadata.official")
    text = lambda name: provenance.filled(o[name])
    named = tables.select("area", F.trim(F.col("table.displayName")).alias("display_name"), o.alias("o")).join(configs.select("area", "mode", "profile", F.lit(True).alias("known")), "area", "left")
    o, url, area = F.col("o"), F.col("o.sourceDownloadUrl"), F.col("area")
    group = F.when(F.col("known"), provenance.source_group(F.col("mode"), F.col("profile"), url, area)).otherwise(provenance.source_group(F.lit("direct"), F.lit(""), url, area, "fallback:"))
    fields = {
        "label": F.coalesce(text("licenseLabel"), F.lit("unknown")), "source_url": text("licenseSourceUrl"), "compatible": F.coalesce(o["osmCompatibility"], F.lit("unknown")),
        "compatible_url": text("osmCompatibilitySourceUrl"), "comment": text("osmCompatibilityComment"),
    }
    made = named.select("area", "display_name", group.alias("group_key"), *[c.alias(n) for n, c in fields.items()])
    return made.withColumn("merge_key", keys.licence_fingerprint(F.col("group_key"), *[F.col(n) for n in fields]))


def data_sources(tables: DataFrame) -> DataFrame:
    """(name, href): the distinct sources of all tables as they are shown; href is null without an address."""
    o = F.col("table.sourceMetadata.official")
    provider, dataset, layer, public, download = SOURCE[:5]
    parts = tables.select(*[provenance.filled(o[n]).alias(n) for n in (provider, dataset, layer)], F.coalesce(provenance.filled(o[public]), provenance.filled(o[download])).alias("href")).distinct()
    name = provenance.source_name(F.col(provider), F.col(dataset), F.col(layer), F.col("href"), F.lit(None).cast("string"))
    # a row of its own, so that the long expression of a name stands in the plan once
    return parts.select(F.inline(F.array(F.struct(name.alias("name"), F.col("href"))))).where("name <> ''").distinct()


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """rows by name as German sorts it, then by its characters: a range sort."""
    return rows.orderBy(key_order(F.col(name), 3), name)


def write_home(spark: SparkSession, path: str, out: str, configs: DataFrame) -> None:
    """Writes ``areas``, ``licences`` and ``sources`` below ``out`` as JSON lines in order, from the tables below ``path``.

    configs: (area, profile, match_property, admin_levels, mode).
    """
    tables = read_comparison_tables(spark, path)
    made = {
        "areas": in_order(match_rules(home_summaries(tables), configs), "area"),
        "licences": in_order(licence_summaries(tables, configs).drop("merge_key"), "area"),
        "sources": in_order(data_sources(tables), "name"),
    }
    for name, rows in made.items():
        rows.write.mode("overwrite").json(f"{out}/{name}")
