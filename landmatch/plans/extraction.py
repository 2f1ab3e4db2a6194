"""Queries of extracts, candidates, geometry helpers, keys as they are written, and audits of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions import extract, geometry, keys
from landmatch.operators import audit, dictionary, metrics, spatial
from landmatch.plans.base import query, table
from landmatch.plans.compare import CORNERS, SUPPLIERS_SQL, suppliers


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map objects with tags: ways on every third order, else relations with a negative id."""
    n, k = F.col("o_orderkey"), F.col("o_custkey")
    tags = F.create_map(F.lit("name"), F.concat(F.lit("n"), k.cast("string")), F.lit("de:regionalschluessel"), F.when(n % 4 == 0, k.cast("string")).otherwise(""), F.lit("admin_level"), (n % 5 + 4).cast("string"), F.lit("postal_code"), F.when(n % 5 != 0, k.cast("string")))
    rows = table(spark, sf_dir, "orders").select(n.alias("seq"), F.when(n % 3 == 0, n.cast("string")).otherwise(" ").alias("osm_way_id"), F.when(n % 3 != 0, -n).alias("osm_id"), F.when(n % 2 == 0, "administrative").otherwise("postal_code").alias("boundary"), tags.alias("tags"))
    return rows.select("*", *extract.promoted(F.col("tags"), ["name", "de:regionalschluessel", "admin_level", "postal_code"]))


AT_ID_SQL = "CASE WHEN o_orderkey = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'way/' ELSE 'relation/' END || o_orderkey"


@query(f"SELECT o_orderkey AS seq, {AT_ID_SQL} AS at_id, 'n' || o_custkey AS name, CAST(o_orderkey % 5 + 4 AS VARCHAR) AS admin_level FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 4 = 0 OR o_orderkey IN (2, 34, 70)) AND o_custkey <> 3 AND o_orderkey NOT IN (6, 66)")
def admin_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administrative boundaries with a key or a listed relation; ways have no relation id."""
    keep = extract.admin_rows(["de:regionalschluessel"], [2, 34, 70], ["name <> 'n3'"])
    return boundaries(spark, sf_dir).where(keep).select("seq", extract.at_id(F.col("osm_way_id"), F.col("osm_id")).alias("at_id"), "name", "admin_level")


@query(f"SELECT o_orderkey AS seq, {AT_ID_SQL} AS at_id, CAST(o_custkey AS VARCHAR) AS postal_code FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0")
def postal_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries(spark, sf_dir).where(extract.postal_rows()).select("seq", extract.at_id(F.col("osm_way_id"), F.col("osm_id")).alias("at_id"), "postal_code")


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'way' ELSE 'relation' END AS osm_type FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 + 4 IN (6, 8) AND NOT (o_orderkey % 3 <> 0 AND o_orderkey IN (32, 34, 2)) AND o_orderkey % 50 BETWEEN 5 AND 40")
def eligible_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate points of two levels, without three relations, inside a box."""
    rows = boundaries(spark, sf_dir).where(extract.admin_candidates(["6", "8", "9"]))
    points = rows.select("seq", "admin_level", keys.candidate_ref(F.col("osm_way_id"), F.col("osm_id").cast("string")).alias("c"), (F.col("seq") % 50).cast("double").alias("x0"), F.lit(1.0).alias("y0")).select("seq", "admin_level", "c.osm_type", "c.osm_id", "x0", "y0")
    return spatial.eligible_points(points, levels=["6", "8"], ignored=["32", "34", "2", "6"], box=(5.0, 0.0, 40.0, 2.0)).select("seq", "osm_type")


@query("SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def prefixed_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's rows whose property begins as configured; the scan takes the prefix."""
    return table(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_brand")


@query("""SELECT string_agg(DISTINCT v, ',' ORDER BY v) AS properties FROM (SELECT unnest([ 'name', 'admin_level', 'de:regionalschluessel']) AS v UNION SELECT DISTINCT p_type FROM part WHERE p_size > 40 AND trim(p_type) <> '')""")
def merged_extract_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All properties that any area asks for, beside those of every extract."""
    asked = table(spark, sf_dir, "part").where("p_size > 40").select(F.trim("p_type").alias("v")).where("v <> ''").distinct()
    always = F.array(*[F.lit(x) for x in ("name", "admin_level", "de:regionalschluessel")])
    return asked.agg(F.array_join(F.array_sort(F.array_distinct(F.concat(always, F.collect_set("v")))), ",").alias("properties"))


@query("SELECT o_orderkey AS seq, lpad(CAST(o_orderkey AS VARCHAR), 5, '0') AS key FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey IN (1, 2, 3, 5, 7, 34)")
def relation_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the configured relations, keyed by their id."""
    at = extract.at_id(F.col("osm_way_id"), F.col("osm_id"))
    rows = boundaries(spark, sf_dir).select("seq", keys.relation_id(at, F.lit(None).cast("string")).alias("r"))
    return rows.where(F.col("r").isin("1", "2", "3", "5", "7", "34")).select("seq", keys.osm_key(F.col("r"), "plz-5").alias("key"))


@query(f"""WITH {SUPPLIERS_SQL} SELECT sid, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, true AS centre_inside, sid % 2 = 0 AS point_inside, sid % 2 = 0 AS meets, round((x1 - x0) * 0.7 * (y1 - y0) * 0.7, 6) AS shrunk_area, x0 AS w, y0 AS s, greatest(x1, 60) AS e, greatest(y1, 60) AS n,
greatest((x0 + x1) / 2 - (x1 - x0) * 2, -180) AS view_w, least((y0 + y1) / 2 + (y1 - y0) * 2, 85) AS view_n, round((x1 - x0) * (y1 - y0) * 12 / 100, 6) AS diff_area FROM sup""")
def geometry_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid, inner point, cover and intersection, shrinking, row boxes and map bounds, on rectangles."""
    geometry.register(spark)
    g, f = geometry.call, F.col
    rect = geometry.rectangle(*[f(c) for c in CORNERS])
    point = g("FromText", F.concat(F.lit("POINT ("), f("x1").cast("string"), F.lit(" "), F.when(f("sid") % 2 == 0, f("y1")).otherwise(f("y1") + 1).cast("string"), F.lit(")")))
    rows = suppliers(spark, sf_dir).select("*", rect.alias("geom"), point.alias("point"))
    centre = g("Envelope", g("Centroid", f("geom")))
    held = rows.select("*", *[f(c).alias(f"a_{c}") for c in CORNERS], *[F.lit(v).alias(f"b_{c}") for c, v in zip(CORNERS, (200.0, 200.0, 60.0, 60.0), strict=True)])
    box = spatial.row_bbox()
    view = spatial.map_bounds(*[f(c) for c in CORNERS])
    return held.select(
        "sid", centre["w"].alias("cx"), centre["s"].alias("cy"), g("Covers", f("geom"), g("PointOnSurface", f("geom"))).alias("centre_inside"), g("Covers", f("geom"), f("point")).alias("point_inside"), g("Intersects", f("geom"), f("point")).alias("meets"),
        F.round(g("Area", g("Shrink", f("geom"), F.lit(0.7))), 6).alias("shrunk_area"), *[c.alias(n) for c, n in zip(box, "wsen", strict=True)], view["w"].alias("view_w"), view["n"].alias("view_n"),
        F.round(metrics.symmetric_diff_area((f("x1") - f("x0")) * (f("y1") - f("y0")), F.lit(12.0)), 6).alias("diff_area"),
    )


# ---- keys as they are written


@query("""SELECT c_custkey, lpad(CAST(1000 + c_nationkey AS VARCHAR), 5, '0') AS transposed, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'p' || c_custkey ELSE 'way/' || c_custkey END AS bucket_id, CASE WHEN c_custkey % 4 < 2 AND c_custkey > 0 THEN c_custkey END AS object_id,
replace(replace(replace(replace(c_name || ' (a)/ü', '#', '%23'), ' ', '%20'), '/', '%2F'), 'ü', '%C3%BC') AS encoded, c_custkey % 3 = 0 AS digit_heavy FROM customer""")
def written_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = k.cast("string")
    ids = F.when(k % 3 == 0, F.array(F.concat(F.lit("way/"), s), F.concat(F.lit("relation/"), s))).otherwise(F.array(F.concat(F.lit("way/"), s)))
    fallback = F.when(k % 3 != 2, F.concat(F.lit("p"), s))
    ref = F.when(k % 4 == 0, F.concat(F.lit("relation/"), s)).when(k % 4 == 1, s).when(k % 4 == 2, F.concat(F.lit("way/"), s)).otherwise("0")
    asked = F.when(k % 3 == 0, F.concat(F.lit(" 12-"), s)).when(k % 3 == 1, F.concat(F.lit("PLZ "), s)).otherwise(" - ")
    known = {str(n): str(1000 + n) for n in range(25)}
    return table(spark, sf_dir, "customer").select(
        "c_custkey", keys.transposed(F.col("c_nationkey"), known, "plz-5").alias("transposed"), keys.bucket_relation_id(ids, fallback).alias("bucket_id"), keys.object_ref(ref).alias("object_id"),
        keys.uri_component(F.concat("c_name", F.lit(" (a)/ü"))).alias("encoded"), keys.is_digit_heavy(asked).alias("digit_heavy"),
    )


@query("SELECT p_partkey, lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) || ' 1/2' AS form FROM part")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are searched: with a no-break space, a zero-width space and a fullwidth digit, which the compatibility form resolves."""
    geometry.register(spark)
    text = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ​１/2 "))
    return table(spark, sf_dir, "part").select("p_partkey", dictionary.name_form(text).alias("form"))


# ---- audits


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    path = F.when(n % 5 == 0, F.concat(F.lit("datasets/a"), n.cast("string"), F.lit("/source/official.fgb"))).when(n % 5 == 1, F.concat(F.lit("datasets/a"), n.cast("string"), F.lit("/output/x.PBF"))).when(n % 5 == 2, ".cache/osm.fgb").otherwise(F.concat(F.lit("datasets/a"), (n % 3).cast("string"), F.lit("/snapshots.json")))
    owner = F.when(n % 3 == 0, "report-runtime").when(n % 3 == 1, "source-cache-osm").otherwise("source-cache-official")
    return table(spark, sf_dir, "pages").select("page_id", owner.alias("owner"), path.alias("path"), F.length("html").cast("bigint").alias("bytes"), "html")


FILES_SQL = """WITH f AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'report-runtime' WHEN 1 THEN 'source-cache-osm' ELSE 'source-cache-official' END AS owner, length(html) AS bytes, html,
CASE page_id % 5 WHEN 0 THEN 'datasets/a' || page_id || '/source/official.fgb' WHEN 1 THEN 'datasets/a' || page_id || '/output/x.PBF' WHEN 2 THEN '.cache/osm.fgb' ELSE 'datasets/a' || page_id % 3 || '/snapshots.json' END AS path FROM pages)"""


@query(f"{FILES_SQL} SELECT page_id, CASE owner WHEN 'report-runtime' THEN page_id % 5 IN (0, 1) WHEN 'source-cache-osm' THEN page_id % 5 <> 2 ELSE page_id % 5 <> 0 END AS violates FROM f")
def ownership_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("page_id", audit.violation(F.col("owner"), F.col("path"), [".cache/osm.fgb"]).alias("violates"))


@query(f"{FILES_SQL} SELECT path, string_agg(DISTINCT owner, ',' ORDER BY owner) AS owners FROM f GROUP BY path HAVING count(*) > 1")
def ownership_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.shared_paths(files(spark, sf_dir)).select("path", F.array_join("owners", ",").alias("owners"))


@query(f"""{FILES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY bytes DESC, path || '#' || page_id) AS n FROM f)
SELECT owner, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (page_id % 5 = 1) AS forbidden, string_agg(path || '#' || page_id || CASE WHEN page_id % 5 = 1 THEN '.pbf' ELSE '' END, ',' ORDER BY n) FILTER (n <= 10) AS largest FROM r GROUP BY owner""")
def scope_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the ten largest files of each owner."""
    named = F.concat("path", F.lit("#"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 1, ".pbf").otherwise(""))
    return audit.inventory(files(spark, sf_dir).withColumn("path", named), ["owner"]).select("owner", "files", "bytes", "forbidden", F.array_join("largest", ",").alias("largest"))


@query(f"{FILES_SQL} SELECT grp, sha256(string_agg(path || '#' || lpad(CAST(page_id AS VARCHAR), 9, '0') || chr(0) || url || chr(0), '' ORDER BY path, page_id)) AS fingerprint FROM (SELECT f.*, p.url, f.page_id % 7 AS grp FROM f JOIN pages p ON f.page_id = p.page_id) GROUP BY grp")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    named = rows.select((F.col("page_id") % 7).alias("grp"), F.concat("path", F.lit("#"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("path"), F.col("url").alias("content"))
    return audit.fingerprint(named, ["grp"])


@query("SELECT n_regionkey AS url, string_agg(n_name, ',' ORDER BY n_name) AS areas FROM nation WHERE n_nationkey % 7 <> 0 GROUP BY n_regionkey")
def sources_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("area"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_regionkey")).alias("url"))
    return audit.grouped_sources(configs).select("url", F.array_join("areas", ",").alias("areas"))


@query("SELECT DISTINCT year(o_orderdate) AS year, o_orderstatus AS url FROM orders WHERE o_orderkey % 2 = 0")
def obsolete_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct years and sources of obsolete fields; fields that are not obsolete have none."""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.year("o_orderdate").cast("bigint").alias("year"), F.col("o_orderstatus").alias("url"))).alias("obsolete"))
    return rows.where("obsolete is not null").select("obsolete.*").dropDuplicates(["year", "url"])
