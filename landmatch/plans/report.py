"""Queries of the report: its relation, filters, sorting, live tags, feature tables and shown numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions import formats, geometry, keys, web
from landmatch.operators import metrics, report, resolver
from landmatch.plans.base import query, table
from landmatch.plans.compare import SIDES_SQL, LEVEL_SQL, measured, polygons
from landmatch.plans.live import placed


@query(f"{SIDES_SQL} SELECT s.key, s.category, round(m.iou, 6) AS iou FROM sides s LEFT JOIN matched m ON s.key = m.key")
def report_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir)
    unmatched = rows.where("category = 'unmatched_osm'").select("key")
    return report.report_rows(rows.select("key", "category", F.round("iou", 6).alias("iou")), unmatched)


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'matched' WHEN 2 THEN 'matched,official_only' WHEN 4 THEN 'matched,unmatched_osm' ELSE 'matched,official_only,unmatched_osm' END AS categories FROM customer""")
def category_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, "").when(k == 1, "matched").when(k == 2, " official_only , matched,matched").when(k == 3, "bogus").otherwise("unmatched_osm,bogus,matched")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(report.chosen_categories(text), ",").alias("categories"))


@query(f"""{SIDES_SQL}, t AS (SELECT s.key, s.category, round(m.iou, 6) AS iou, {LEVEL_SQL.replace('iou', 'm.iou').replace('symmetric_diff_pct', 'm.symmetric_diff_pct').replace('area_diff_pct', 'm.area_diff_pct')} AS level, m.key IS NOT NULL AS has FROM sides s LEFT JOIN matched m ON s.key = m.key)
SELECT key, row_number() OVER (ORDER BY iou ASC NULLS LAST, key) AS by_iou, row_number() OVER (ORDER BY CASE WHEN NOT has THEN NULL WHEN level = 'ok' THEN 1 WHEN level = 'review' THEN 2 ELSE 3 END DESC NULLS LAST, key) AS by_issue FROM t""")
def report_sort_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place under two keys of the table; rows without a value come last both ways."""
    rows = measured(spark, sf_dir).select("key", "category", F.round("iou", 6).alias("iou"), F.col("issue.level").alias("level"))
    by_iou = placed(rows, [*report.sort_order("iou", descending=False), F.asc("key")]).select("key", F.col("place").alias("by_iou"))
    by_issue = placed(rows, [*report.sort_order("issue"), F.asc("key")]).select("key", F.col("place").alias("by_issue"))
    return by_iou.join(by_issue, "key")


@query("""SELECT name, row_number() OVER (ORDER BY lower(name) DESC, id) AS place FROM (SELECT DISTINCT p_name || p_partkey % 2 AS name, p_partkey AS id FROM part WHERE p_name IS NOT NULL)""")
def report_sort_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names sorted by a German collation that passes over case and accents."""
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", (F.col("p_partkey") % 2).cast("string")).alias("name"), F.col("p_partkey").alias("id"), F.lit("").alias("key"))
    return placed(rows, [*report.sort_order("name"), F.asc("id")]).select("name", "place")


@query("SELECT area, arg_max(mean, y) AS mean FROM (SELECT o_orderstatus AS area, year(o_orderdate) AS y, count(*)::DOUBLE AS mean FROM orders GROUP BY ALL) WHERE y < 1998 OR mean IS NULL GROUP BY area")
def series_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from 1998 on have no finite value."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("area"), F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("n"))
    return report.latest_value(runs.withColumn("mean", F.when(F.col("y") < 1998, F.col("n")).otherwise(F.lit(float("nan")))), ["area"], "y", "mean")


@query(f"""{SIDES_SQL} SELECT 'focus' AS layer, key FROM sides WHERE category <> 'unmatched_osm' AND key = '00002'
UNION ALL SELECT 'allowed', key FROM sides WHERE category <> 'official_only' AND key IN ('00001', '00004', '00007') UNION ALL SELECT 'all', key FROM sides WHERE category <> 'official_only'""")
def map_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of four layers; the last one allows none."""
    rows = measured(spark, sf_dir)
    sided = lambda keep, source: rows.where(keep).select(F.col("key").alias("feature_id"), F.lit("overlay").alias("role"), F.lit(source).alias("source"))
    features = sided("category <> 'unmatched_osm'", "external").unionByName(sided("category <> 'official_only'", "osm"))
    layers = {"focus": report.layer_filter("overlay", "external", focus="00002"), "allowed": report.layer_filter("overlay", "osm", allowed=["00001", "00004", "00007"]), "all": report.layer_filter("overlay", "osm"), "none": report.layer_filter("overlay", "osm", allowed=[])}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in layers.items()]))
    return features.select(F.explode(names).alias("layer"), F.col("feature_id").alias("key"))


ADE_SQL = "CASE k % 7 WHEN 1 THEN ['2'] WHEN 2 THEN ['4'] WHEN 3 THEN ['5'] WHEN 4 THEN ['6'] WHEN 5 THEN ['7'] WHEN 6 THEN ['7', '8'] END"


@query(f"""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ags FROM customer), r AS (
SELECT k, 'name' AS tag, n AS value, 'equal' AS state FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'admin_level', '7', CASE WHEN {ADE_SQL} IS NULL THEN 'unmapped' WHEN list_contains({ADE_SQL}, '7') THEN 'equal' ELSE 'different' END FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'other', 'x', 'unmapped' FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'name', 'x', 'different' FROM c WHERE k % 3 = 1
UNION ALL SELECT k, 'admin_title:de', s, 'equal' FROM c WHERE k % 3 = 1
UNION ALL SELECT k, 'de:amtlicher_gemeindeschluessel', ags, 'equal' FROM c WHERE k % 3 = 2
UNION ALL SELECT k, 'de:amtlicher_gemeindeschluessel', ags, 'missing' FROM c WHERE k % 3 <> 2
UNION ALL SELECT k, 'admin_title', s, 'missing' FROM c WHERE k % 3 <> 1
UNION ALL SELECT k, 'name', n, 'missing' FROM c WHERE k % 3 = 2
UNION ALL SELECT k, 'admin_level', CAST(k % 7 AS VARCHAR), 'missing' FROM c WHERE k % 3 <> 0 AND k % 7 <> 0) SELECT * FROM r""")
def live_tag_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), "c_name", "c_mktsegment", F.lpad(k.cast("string"), 8, "0").alias("ags"))
    pair = lambda a, b: F.struct(F.lit(a).alias("t"), b.alias("value"))
    official = rows.select("k", F.explode(F.array(pair("AGS", F.col("ags")), pair("GEN", F.concat(F.lit(" "), "c_name")), pair("BEZ", F.col("c_mktsegment")), pair("ADE", (F.col("k") % 7).cast("string")), pair("XYZ", F.lit("1")))).alias("p")).select("k", F.col("p.t").alias("name"), "p.value")
    tags = F.when(F.col("k") % 3 == 0, F.array(pair("name", F.col("c_name")), pair("admin_level", F.lit("7")), pair("other", F.lit("x")))).when(F.col("k") % 3 == 1, F.array(pair("name", F.lit("x")), pair("admin_title:de", F.concat("c_mktsegment", F.lit(" "))))).otherwise(F.array(pair("de:amtlicher_gemeindeschluessel", F.col("ags"))))
    live = rows.select("k", F.explode(tags).alias("p")).select("k", F.col("p.t").alias("tag"), "p.value")
    return report.live_tags(official, live, ["k"])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey IS NOT NULL")
def snapshot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live values that the snapshot has; NaN and dashes match nothing."""
    nation = table(spark, sf_dir, "nation")
    snapshot = nation.select(F.col("n_nationkey").alias("nation"), F.explode(F.array("n_name", F.lit("NaN"), F.lit("---"))).alias("value"))
    k = F.col("s_suppkey")
    live = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(k % 3 == 0, F.concat(F.lit(" "), "n_name", F.lit(" "))).when(k % 3 == 1, "NaN").otherwise("---").alias("value"))
    return report.values_in_snapshot(live, snapshot, ["nation"]).select("s_suppkey")


@query("SELECT event_id FROM events WHERE event_id % 10 <> 0 OR event_id % 11 = 0")
def visible_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not hidden; every eleventh has no key."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 11 != 0, web.row_key(F.lit("wfs"), F.col("event_type"), n.cast("string"), n)).alias("row_key"))
    return report.without_hidden(rows, rows.where("event_id % 10 = 0").select("row_key")).select("event_id")


@query("""SELECT page_id, (SELECT count(*) FROM pages q WHERE q.page_id % 2 = 0 AND regexp_replace(trim(regexp_replace(q.url, '[?#].*$', '')), '(.)/$', '\\1') = regexp_replace(trim(regexp_replace(p.url, '[?#].*$', '')), '(.)/$', '\\1')) AS issues FROM pages p""")
def issues_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that name a path, however it is written."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    issues = pages.where("page_id % 2 = 0").select(keys.path_match(F.concat(F.lit(" "), "path", F.lit(" "))).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    return pages.select("page_id", keys.path_match(F.col("path")).alias("at")).join(issues, "at", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("issues"))


@query(f"""{SIDES_SQL} SELECT key, u.tag, u.value FROM (SELECT key FROM sides WHERE category = 'official_only'), LATERAL (VALUES ('boundary', 'administrative'), ('admin_level', '6'), ('admin_level', '8'), ('de:regionalschluessel', key)) u(tag, value)""")
def expected_editor_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.editor_tags(measured(spark, sf_dir), "key", "administrative", ["6", "8"], [" de:regionalschluessel ", " "])


@query(f"""{SIDES_SQL}, t AS (SELECT s.*, a.has FROM sides s LEFT JOIN a ON s.key = a.key)
SELECT coalesce(area, '') AS area, 'overlay' AS layer, key AS feature_id, 'external' AS source FROM t WHERE has
UNION ALL SELECT coalesce(area, ''), 'overlay', key, 'osm' FROM t WHERE category <> 'unmatched_osm' AND ba IS NOT NULL
UNION ALL SELECT coalesce(area, ''), 'diff', key, 'external' FROM t WHERE has AND (category = 'official_only' OR aa > lap)
UNION ALL SELECT coalesce(area, ''), 'diff', key, 'osm' FROM t WHERE has AND category = 'matched' AND ba > lap
UNION ALL SELECT '', 'unmatched', key, 'osm' FROM t WHERE category = 'unmatched_osm'""")
def feature_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polygons(spark, sf_dir).withColumn("area", F.coalesce("area", F.lit("")))
    e = geometry.call("Envelope", F.col("geom"))
    corner = geometry.call("FromText", F.concat(F.lit("POINT ("), F.max(e["e"]).cast("string"), F.lit(" "), F.max(e["n"]).cast("string"), F.lit(")")))
    return report.feature_tables(rows, ["area"], "key", corner).select("area", "layer", "feature_id", "source")


@query("SELECT l_returnflag, greatest(coalesce(max(l_discount) FILTER (l_quantity % 2 = 0), 0), 0) AS top FROM lineitem GROUP BY 1")
def finite_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest finite value; odd quantities give none."""
    value = F.when(F.col("l_quantity") % 2 == 0, F.col("l_discount")).when(F.col("l_quantity") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(metrics.finite_max(value).alias("top"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'unmatched' ELSE 'main' END AS found_in FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature is looked up in the main table and then among the unmatched."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    both = k.where("key % 3 <> 0").select("key", F.lit(0).alias("at"), F.lit("main").alias("found_in")).unionByName(k.where("key % 2 = 0").select("key", F.lit(1).alias("at"), F.lit("unmatched").alias("found_in")))
    return resolver.first_found(both, ["key"], "at").select("key", "found_in")


DE = "replace(replace(replace({x}, ',', '~'), '.', ','), '~', '.')"


@query(f"""SELECT o_orderkey, CASE WHEN v = 0 THEN '0' WHEN v > 10 THEN {DE.format(x="format('{:,}', CAST(round(v) AS BIGINT))")} ELSE replace(regexp_replace(CAST(round(v, 2) AS VARCHAR), '\\.0$', ''), '.', ',') END || chr(160) || '%' AS percent,
CASE WHEN v < 1 THEN replace(regexp_replace(CAST(round(v, 2) AS VARCHAR), '\\.0$', ''), '.', ',') WHEN v < 10 THEN replace(regexp_replace(CAST(round(v, 1) AS VARCHAR), '\\.0$', ''), '.', ',') ELSE {DE.format(x="format('{:,}', CAST(round(v) AS BIGINT))")} END || chr(160) || 'm' AS metres,
CASE WHEN v < 0.1 THEN {DE.format(x="format('{:,}', CAST(round(v * 1000000) AS BIGINT))")} || chr(160) || 'm²' WHEN v < 1 THEN replace(regexp_replace(CAST(round(v, 2) AS VARCHAR), '\\.0$', ''), '.', ',') || chr(160) || 'km²'
WHEN v < 10 THEN replace(regexp_replace(CAST(round(v, 1) AS VARCHAR), '\\.0$', ''), '.', ',') || chr(160) || 'km²' ELSE {DE.format(x="format('{:,}', CAST(round(v) AS BIGINT))")} || chr(160) || 'km²' END AS area
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey * 1.0 WHEN 1 THEN (o_orderkey % 100) / 100.0::DOUBLE WHEN 2 THEN (o_orderkey % 100) / 10.0::DOUBLE ELSE o_custkey % 11 * 1.0 END AS v FROM orders)""")
def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    v = F.when(n % 4 == 0, c.cast("double")).when(n % 4 == 1, (n % 100) / F.lit(100.0)).when(n % 4 == 2, (n % 100) / F.lit(10.0)).otherwise((c % 11).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", formats.percent_points(F.col("v")).alias("percent"), formats.metres(F.col("v")).alias("metres"), formats.area(F.col("v") * 1_000_000).alias("area"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 OR z > 24 THEN NULL ELSE z END AS zoom, CASE WHEN event_id % 3 = 2 OR z > 24 THEN NULL ELSE event_id % 90 + 0.5 END AS lat, CASE WHEN event_id % 3 = 2 OR z > 24 THEN NULL ELSE -(event_id % 180)::DOUBLE END AS lon,
CAST(greatest(least(floor(14 - log2((event_id % 100 + 1) / 100.0::DOUBLE * 45) + 0.5), 18), 11) AS INTEGER) AS editor_zoom
FROM (SELECT event_id, (event_id % 26)::DOUBLE AS z FROM events)""")
def map_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views read from addresses; a third of them have a part too few."""
    n = F.col("event_id")
    s = lambda c: c.cast("string")
    text = F.when(n % 3 == 2, "5/6").otherwise(F.concat_ws("/", s(n % 26), F.concat(s(n % 90), F.lit(".5")), F.concat(F.lit("-"), s(n % 180), F.lit("px"))))
    span = (n % 100 + 1) / F.lit(100.0)
    zoom = web.editor_zoom(F.lit(0.0), F.lit(0.0), span, span / 2)
    return table(spark, sf_dir, "events").select("event_id", web.map_view(text).alias("v"), zoom.alias("editor_zoom")).select("event_id", "v.*", "editor_zoom")
