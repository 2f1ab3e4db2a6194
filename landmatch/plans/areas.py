"""Queries of the home page's index, the registry of discussions, and runs beside the ones before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions import geometry
from landmatch.operators import areas, discussions, history, live, metrics, spatial
from landmatch.plans.base import query, stamp, stamp_sql, table
from landmatch.plans.history import LOG_SQL, _latest, log


def _json(area: Column, name: Column, rows: Column, unmatched: Column, source: Column) -> Column:
    fixed = [F.lit("x").alias(n) for n in areas.TABLE_TEXTS if n not in ("area", "displayName")]
    return F.to_json(F.struct(area.alias("area"), name.alias("displayName"), *fixed, F.lit(True).alias("hasPmtiles"), F.struct(F.lit("AGS").alias("officialMatchProperty")).alias("filterConfigSummary"), F.struct(source.alias("official")).alias("sourceMetadata"), rows.alias("rows"), unmatched.alias("unmatchedOsm")))


def _row(line: Column) -> list[Column]:
    return [F.substring(line, 1, 3).alias("canonicalMatchKey"), line.alias("nameLabel"), F.length(line).cast("string").alias("osmRelationId")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison table per document: its lines are rows by their lengths. Some are cut short, have no name, or hold a category that is none."""
    k = F.col("doc_id")
    lines = F.split("text", "\n")
    size = lambda x: F.length(x)
    level = lambda x: F.struct(F.when(size(x) % 5 == 0, "ok").when(size(x) % 5 == 1, "review").otherwise("issue").alias("level"))
    measured = lambda x: F.when(size(x) % 5 < 4, F.struct(*[F.lit(0.5).alias(n) for n in areas.NUMBERS], F.when(size(x) % 5 < 3, level(x)).alias("issueIndicator")))
    kind = lambda x: F.when(size(x) % 3 == 1, "official_only").when(k % 13 == 0, "odd").otherwise("matched")
    rows = F.transform(F.filter(lines, lambda x: size(x) % 3 < 2), lambda x: F.struct(*_row(x), kind(x).alias("category"), measured(x).alias("metrics")))
    unmatched = F.transform(F.filter(lines, lambda x: size(x) % 3 == 2), lambda x: F.struct(*_row(x)))
    source = F.struct(F.lit("https://h.org/").alias("sourcePublicUrl"), F.lit("https://h.org/d").alias("sourceDownloadUrl"))
    area = F.concat(F.lit("d"), k.cast("string"))
    whole = _json(area, F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" Area "), "source")), rows, unmatched, source)
    return table(spark, sf_dir, "documents").select(area.alias("area"), F.when(k % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("text"))


@query("""WITH l AS (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS n FROM documents),
c AS (SELECT doc_id, source, len(list_filter(n, lambda x: x % 3 = 0)) AS matched, len(list_filter(n, lambda x: x % 3 = 1)) AS official_only, len(list_filter(n, lambda x: x % 3 = 2)) AS unmatched_osm, len(list_filter(n, lambda x: x % 3 < 2 AND x % 5 = 1)) AS reviews, len(list_filter(n, lambda x: x % 3 < 2 AND x % 5 = 2)) AS issues FROM l)
SELECT 'd' || doc_id AS area, 'Area ' || source AS display_name, matched, official_only, unmatched_osm, reviews, issues,
  CASE doc_id % 3 WHEN 0 THEN 'de:regionalschluessel' WHEN 1 THEN 'ref' END AS match_properties, CASE WHEN doc_id % 3 < 2 AND doc_id % 2 = 0 THEN '6,8' END AS admin_levels
FROM c WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND NOT (doc_id % 13 = 0 AND matched > 0)""")
def areas_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home summaries of all sound tables, with the match rules of those whose settings can be read (two thirds)."""
    k = F.col("doc_id")
    configs = table(spark, sf_dir, "documents").where(k % 3 < 2).select(
        F.concat(F.lit("d"), k.cast("string")).alias("area"), F.when(k % 3 == 0, "admin_rs").otherwise("plain").alias("profile"), F.lit("ref").alias("match_property"),
        F.when(k % 2 == 0, F.array(F.lit("6"), F.lit("8"))).otherwise(F.array().cast("array<string>")).alias("admin_levels"),
    )
    found = areas.match_rules(areas.home_summaries(areas.comparison_tables(_documents(spark, sf_dir))), configs)
    return found.withColumns({c: F.array_join(c, ",") for c in ("match_properties", "admin_levels")})


@query("""WITH l AS (SELECT source, length(unnest(string_split(text, chr(10)))) AS n FROM documents)
SELECT source, count(*) FILTER (n % 3 = 0) AS matched, count(*) FILTER (n % 3 = 1) AS official_only, count(*) FILTER (n % 3 = 2) AS unmatched_osm, count(*) FILTER (n % 3 < 2 AND n % 5 = 1) AS reviews, count(*) FILTER (n % 3 < 2 AND n % 5 = 2) AS issues FROM l GROUP BY source""")
def stored_area_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from rows as they are stored: an area per source."""
    n = F.length("line")
    rows = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    named = rows.select("source", F.when(n % 3 == 0, "matched").when(n % 3 == 1, "official_only").otherwise("unmatched_osm").alias("category"), F.when(n % 5 == 0, "ok").when(n % 5 == 1, "review").when(n % 5 == 2, "issue").alias("level"))
    return areas.home_counts(named, ["source"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison table per page, whose source is the page. Every eleventh has an unknown verdict, every thirteenth no address, so both are malformed."""
    k = F.col("page_id")
    none = F.array().cast("array<string>")
    source = F.struct(
        F.when(k % 13 != 0, F.concat(F.lit(" "), "url")).otherwise("/here").alias("sourcePublicUrl"), F.col("url").alias("sourceDownloadUrl"), F.when(k % 2 == 0, "HTTP").when(k % 3 == 0, "Office").alias("provider"), F.when(k % 4 == 1, "set").otherwise("").alias("dataset"),
        F.when(k % 3 == 0, F.concat(F.lit("L"), (k % 5).cast("string"))).when(k % 3 == 1, " ").alias("licenseLabel"), F.when(k % 11 == 0, "maybe").when(k % 5 == 0, "no").when(k % 5 == 1, "yes_waiver").alias("osmCompatibility"),
        F.when(k % 9 == 0, "").when(k % 9 == 1, "https://l.org/").alias("licenseSourceUrl"),
    )
    area = F.concat(F.lit("p"), k.cast("string"))
    return table(spark, sf_dir, "pages").select(area.alias("area"), _json(area, F.lit("Page"), none, none, source).alias("text"))


_SOUND = "page_id % 11 <> 0 AND page_id % 13 <> 0"


@query(f"""WITH s AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'preset:bkg_vg25' WHEN 1 THEN 'preset:other' ELSE 'download:' || url END AS group_key, CASE WHEN page_id % 3 = 0 THEN 'L' || page_id % 5 ELSE 'unknown' END AS label,
  CASE WHEN page_id % 9 = 1 THEN 'https://l.org/' END AS source_url, CASE page_id % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes_waiver' ELSE 'unknown' END AS compatible FROM pages WHERE {_SOUND})
SELECT 'p' || page_id AS area, group_key, label, source_url, compatible, concat_ws(chr(31), group_key, label, coalesce(source_url, ''), compatible, '', '') AS merge_key FROM s""")
def area_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence summaries of all sound tables; a third have no settings and are grouped by their address."""
    k = F.col("page_id")
    configs = table(spark, sf_dir, "pages").where(k % 3 < 2).select(F.concat(F.lit("p"), k.cast("string")).alias("area"), F.lit("profile").alias("mode"), F.when(k % 3 == 0, "bkg_vg25_x").otherwise("other").alias("profile"))
    found = areas.licence_summaries(areas.comparison_tables(_pages(spark, sf_dir)), configs)
    return found.select("area", "group_key", "label", "source_url", "compatible", "merge_key")


@query(f"""WITH s AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN page_id % 4 = 1 THEN 'set' ELSE '' END AS dataset FROM pages WHERE {_SOUND})
SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN host WHEN page_id % 3 = 0 AND dataset <> '' THEN 'Office (set)' WHEN page_id % 3 = 0 THEN 'Office' WHEN dataset <> '' THEN 'set' ELSE url END AS name, url AS href FROM s""")
def area_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of all sound tables, as they are shown."""
    return areas.data_sources(areas.comparison_tables(_pages(spark, sf_dir)))


@query("""SELECT regexp_replace(trim(regexp_replace(url, '[?#].*$', '')), '(.)/$', '\\1') AS match, page_id + 1 AS number, url, CASE WHEN page_id % 3 = 0 THEN 'open' ELSE 'closed' END AS state, '2024-01-0' || (page_id % 9 + 1) || 'T00:00:00Z' AS last_touched_at FROM pages WHERE page_id % 5 <> 0""")
def discussion_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues about pages; every fifth is a pull request."""
    k = F.col("page_id")
    issues = table(spark, sf_dir, "pages").select(
        (k + 1).alias("number"), F.concat(F.lit(" "), F.regexp_replace("url", "[?#].*$", ""), F.lit(" ")).alias("title"), F.col("url").alias("html_url"), F.when(k % 3 == 0, "open").when(k % 3 == 1, "closed").alias("state"),
        F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("updated_at"), F.when(k % 5 == 0, F.struct(F.col("url"))).alias("pull_request"),
    )
    return discussions.registry(issues)


@query(f"""{LOG_SQL}, s AS (SELECT max(ts) AS done, false AS busy FROM events UNION ALL SELECT max(ts) + INTERVAL 1 DAY, true FROM events)
SELECT {_latest('compare')} AS last_compare_ok_at, {_latest('download')} AS last_download_ok_at, (SELECT {stamp_sql('greatest(max(published_at), (SELECT max(done) FROM s WHERE NOT busy))')} FROM runs) AS last_published_at""")
def status_kpis_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures beside two states: one completed at the last event, and one in progress, which does not count."""
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("at"))
    state = last.select(F.explode(F.array(F.struct(F.lit(False).alias("in_progress"), F.col("at").alias("completed_at")), F.struct(F.lit(True).alias("in_progress"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("completed_at")))).alias("s")).select("s.*")
    k = history.key_figures(history.fold_runs(log(spark, sf_dir)), state)
    return k.select(*[stamp(F.col(c)).alias(c) for c in k.columns])


@query("""WITH g AS (SELECT l_returnflag AS area, l_partkey AS key, l_linestatus = 'O' AS cur, max(CASE WHEN l_partkey % 9 <> 0 OR l_linestatus = 'O' THEN l_discount END) AS iou, max(l_tax) AS symmetric_diff_pct, max(l_quantity) AS area_diff_pct, max(l_extendedprice) AS hausdorff_norm FROM lineitem GROUP BY ALL)
SELECT c.area, c.key, c.iou, p.iou AS prev_iou, c.area_diff_pct, p.area_diff_pct AS prev_area_diff_pct FROM g c JOIN g p ON c.area = p.area AND c.key = p.key AND c.cur AND NOT p.cur WHERE c.iou IS NOT NULL AND p.iou IS NOT NULL""")
def metrics_beside_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines as a run, finished ones as the run before, in which every ninth key was not measured."""
    lines = table(spark, sf_dir, "lineitem")
    names = {"iou": "l_discount", "symmetric_diff_pct": "l_tax", "area_diff_pct": "l_quantity", "hausdorff_norm": "l_extendedprice"}
    run = lambda status: lines.where(F.col("l_linestatus") == status).groupBy(F.col("l_returnflag").alias("area"), F.col("l_partkey").alias("key")).agg(*[F.max(c).alias(m) for m, c in names.items()])
    before = run("F").withColumn("iou", F.when(F.col("key") % 9 != 0, F.col("iou")))
    return metrics.beside_previous(run("O"), before, ["area"], "key", list(names)).select("area", "key", "iou", "prev_iou", "area_diff_pct", "prev_area_diff_pct")


@query("""SELECT o_orderkey, o_custkey % 97 + CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS w, CAST(o_custkey % 71 AS DOUBLE) AS s, o_custkey % 97 + 2.0::DOUBLE AS e, o_custkey % 71 + CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 1 END::DOUBLE AS n FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 <> 0""")
def feature_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as stored with a third of the features; others have a part that is no finite number and are measured; some have neither."""
    geometry.register(spark)
    k, x, y = F.col("o_orderkey"), F.col("o_custkey") % 97, F.col("o_custkey") % 71
    text = lambda c: c.cast("string")
    props = F.create_map(F.lit("_bbox_minx"), text(x + 0.5), F.lit("_bbox_miny"), text(y), F.lit("_bbox_maxx"), F.when(k % 3 == 0, text(x + 2)).when(k % 3 == 1, "NaN").otherwise("wide"), F.lit("_bbox_maxy"), text(y + 7))
    geom = F.when(k % 7 != 0, geometry.rectangle(x, y, x + 2, y + 1)).when(k % 2 == 0, F.lit(b"broken"))
    return table(spark, sf_dir, "orders").select("o_orderkey", spatial.feature_box(props, geom).alias("b")).where("b is not null").select("o_orderkey", "b.*")


@query("""SELECT doc_id, 'wfs:' || source || ':' || CASE WHEN doc_id % 4 < 2 THEN CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS VARCHAR) ELSE 'id-' || doc_id END AS row_key FROM documents""")
def live_keys_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of live rows, numbered inside their source; half of them have no id."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(k % 4 > 1, F.concat(F.lit("id-"), k.cast("string"))).when(k % 4 == 1, "").alias("ident"))
    return live.row_keys(rows, "source", "ident", ["n_chars", "doc_id"], F.lit("wfs")).select("doc_id", "row_key")
