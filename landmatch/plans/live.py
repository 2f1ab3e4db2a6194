"""Queries over pages and live services: request texts, answers, dates, sizes and report sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landmatch.functions import keys, web
from landmatch.plans.base import query, shared, table
from landmatch.plans.compare import CORNERS, suppliers


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(trim(regexp_replace(url, '[?#].*$', '')), '(.)/$', '\\1') AS path FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.parse_url("url", F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("protocol"), part("HOST").alias("host"), keys.path_match(F.regexp_replace("url", "[?#].*$", "")).alias("path"))


@query("""SELECT page_id, CASE WHEN label AND d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 THEN '2024-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') END AS day
FROM (SELECT page_id, page_id % 35 AS d, page_id % 14 AS m, page_id % 4 <> 3 AS label FROM pages)""")
def html_date_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth page has a date without the label."""
    n = F.col("page_id")
    label = F.when(n % 4 == 0, "Aktualit&auml;tsstand:&nbsp;").when(n % 4 == 1, "<b>AKTUALITAETSSTAND: ").when(n % 4 == 2, "Aktualitätsstand:").otherwise("Stand: ")
    text = F.concat("html", F.lit(" 01.01.1999 "), label, (n % 35).cast("string"), F.lit("."), (n % 14).cast("string"), F.lit(".2024</b>"))
    return table(spark, sf_dir, "pages").select("page_id", web.reference_date(text).alias("day"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00.000Z' ELSE '2023-06-0' || (page_id % 9 + 1) || 'T10:30:00.000Z' END AS updated,
CASE WHEN page_id % 5 = 0 THEN NULL ELSE '2020-05-0' || (page_id % 9 + 1) || 'T00:00:00.000Z' END AS published FROM pages""")
def xml_like_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's stamp, publications and revisions; the last revision and the first publication count."""
    n = F.col("page_id")
    dated = lambda day, kind: F.concat(F.lit("<gmd:CI_Date><gmd:date><gco:Date>"), day, F.lit(f"</gco:Date></gmd:date><gmd:CI_DateTypeCode codeListValue='{kind}'/></gmd:CI_Date>"))
    day = lambda month, time="": F.concat(F.lit(f"{month}-0"), (n % 9 + 1).cast("string"), F.lit(time))
    stamp = F.concat(F.lit("<gmd:dateStamp><gco:Date>2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("</gco:Date></gmd:dateStamp>"))
    published = F.when(n % 5 == 0, dated(F.lit("unknown"), "publication")).otherwise(F.concat(dated(day("2020-05"), "Publication"), dated(day("2021-05"), "creation")))
    revised = F.when(n % 3 == 0, "").otherwise(F.concat(dated(day("2022-06"), "revision"), dated(day("2023-06", "T12:30:00+02:00"), "revision")))
    return table(spark, sf_dir, "pages").select("page_id", web.metadata_dates(F.concat(stamp, published, revised)).alias("d")).select("page_id", "d.updated", "d.published")


@query("""SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '?service=wfs&version=1.1.0&request=GetFeature&typeName=vg%3A' || page_id || '&bbox=' || page_id || '%2C1%2C2.5%2C3%2CEPSG%3A4326&maxFeatures=50&srsName=EPSG%3A4326'
  ELSE '?service=wfs&version=2.0.0&request=GetFeature&typeNames=vg%3A' || page_id || '&bbox=1%2C' || page_id || '%2C3%2C2.5%2Curn%3Aogc%3Adef%3Acrs%3AEPSG%3A%3A4326&count=50&srsName=EPSG%3A4326' END
  || CASE WHEN page_id % 3 = 0 THEN '&outputFormat=application%2Fjson' ELSE '' END AS url FROM pages""")
def wfs_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    version = F.when(n % 2 == 0, "1.1.0").otherwise("2.0.0")
    form = F.when(n % 3 == 0, " application/json ").otherwise(" ")
    box = (n, F.lit(1.0), F.lit(2.5), F.lit(3.0))
    return table(spark, sf_dir, "pages").select("page_id", web.wfs_url(F.col("url"), F.concat(F.lit("vg:"), n.cast("string")), version, box, output_format=form).alias("url"))


OVERPASS_BOX_SQL = "'(' || CAST(s_suppkey * 17 % 79 AS INTEGER) || ',' || CAST(s_suppkey * 13 % 110 AS INTEGER) || ',' || CAST(s_suppkey * 17 % 79 + 4 + s_suppkey % 6 AS INTEGER) || ',' || CAST(s_suppkey * 13 % 110 + 4 + s_suppkey % 9 AS INTEGER) || ');'"


@query(f"""SELECT sid, replace('[out:json][timeout:90];~(~  relation["boundary"="administrative"]' || b || '~  way["boundary"="administrative"]' || b || '~);~out geom;', '~', chr(10)) AS boundaries,
replace('[out:json][timeout:90];~(~  node["addr:postcode"]' || b || '~  way["addr:postcode"]' || b || '~);~out center;', '~', chr(10)) AS postcodes, replace('[out:json][timeout:25];~relation(' || sid || ');~out tags;', '~', chr(10)) AS tags
FROM (SELECT s_suppkey AS sid, {OVERPASS_BOX_SQL} AS b FROM supplier)""")
def overpass_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = tuple(F.col(c) for c in CORNERS)
    return suppliers(spark, sf_dir).select("sid", web.overpass_query("administrative", box).alias("boundaries"), web.overpass_query("addr_postcode", box).alias("postcodes"), web.relation_tags_query(F.col("sid")).alias("tags"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'way' ELSE 'relation' END AS type, user_id AS id, event_type AS name, CAST(event_id % 10 AS INTEGER) AS bucket FROM events WHERE event_id % 3 <> 2""")
def overpass_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of answers; nodes are no hits."""
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, "relation").when(n % 3 == 1, "way").otherwise("node")
    body = F.concat(F.lit('{"elements":[{"type":"'), kind, F.lit('","id":'), F.col("user_id").cast("string"), F.lit(',"tags":{"name":"'), "event_type", F.lit('"}}]}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(web.overpass_hits(body)).alias("h"))
    return rows.select("event_id", "h.type", "h.id", F.try_element_at("h.tags", F.lit("name")).alias("name"), keys.postal_bucket(n.cast("string")).alias("bucket"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'relation' WHEN 1 THEN 'way' WHEN 2 THEN 'way' WHEN 3 THEN 'relation' WHEN 4 THEN 'way' END AS type, CASE WHEN event_id % 6 < 5 THEN user_id END AS id,
CASE event_id % 6 WHEN 4 THEN 'some label' WHEN 5 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS label FROM events""")
def object_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of rendered features in the forms they come in: a field of the kind, a typed text, a number, and text that is no id."""
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    wrap = lambda head, tail: F.concat(F.lit(head), u, F.lit(tail))
    text = (
        F.when(n % 6 == 0, wrap('{"relation_id":', ',"id":7}')).when(n % 6 == 1, wrap('{"way_id":', "}")).when(n % 6 == 2, wrap('{"@id":" way/', '","osm_id":3}'))
        .when(n % 6 == 3, wrap('{"@type":"relation","id":', "}")).when(n % 6 == 4, wrap('{"osm_id":', ',"label":" some label "}')).otherwise(wrap('{"id":"', '"}'))
    )
    return table(spark, sf_dir, "events").select("event_id", web.object_identity(text).alias("o")).select("event_id", "o.*")


@query("SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id AS u FROM events WHERE event_id % 7 = 0) r WHERE r.u = e.user_id) AND event_id % 2 = 0")
def rendered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of objects that are drawn: relations of users that some drawn feature names."""
    events = table(spark, sf_dir, "events")
    hits = events.select("event_id", F.when(F.col("event_id") % 2 == 0, "relation").otherwise("way").alias("type"), F.col("user_id").alias("id"))
    drawn = events.where("event_id % 7 = 0").select(web.object_identity(F.concat(F.lit('{"relation_id":'), F.col("user_id").cast("string"), F.lit("}"))).alias("o")).select("o.type", "o.id").distinct()
    return hits.join(drawn, ["type", "id"], "left_semi").select("event_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents")
def table_sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its place: a range sort, numbered per partition, plus the rows of the partitions before."""
    return placed(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc_nulls_last("n_chars"), F.asc("doc_id")]).select("doc_id", "place")


def placed(rows: DataFrame, order: list) -> DataFrame:
    """rows with their place (long, from 1) in the order. The sorted rows are cut from their lineage, so that both uses see the same partitions."""
    at = shared(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = at.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    numbered = at.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(bases), "_part").withColumn("place", F.col("_base") + F.col("_n")).select(*rows.columns, "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


#: Places of files below an area's folder, by number, and their kinds.
PLACES = ("snapshots.json", "output/comparison_table.json", "output/comparison.pmtiles", "output/features/1.json", "output/official_for_edit/a.geojson", "output/_build/x.fgb", "output/detailed_results.csv", "source/official.fgb", "")
KINDS_SQL = "['snapshots', 'comparison_table_json', 'comparison_pmtiles', 'feature_shards', 'official_for_edit', 'ephemeral_build', 'obsolete_legacy', 'other_internal_or_source', 'other'][CAST(page_id % 9 AS INTEGER) + 1]"


@query(f"SELECT {KINDS_SQL} AS category, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def file_category_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("area/"), F.get(F.array(*[F.lit(p) for p in PLACES]), (F.col("page_id") % 9).cast("int")))
    return table(spark, sf_dir, "pages").groupBy(web.file_kind(path).alias("category")).agg(F.count("*").alias("files"), F.sum(F.length("html")).cast("bigint").alias("chars"))


@query("SELECT category, url, CAST(n AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n, page_id) AS r, count(*) OVER (PARTITION BY category) AS c FROM (SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS category, url, page_id, length(html) AS n FROM pages)) WHERE r = (c - 1) // 2 + 1")
def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle file of each category: sizes are counted first, so that what is ordered per category is sizes, not files."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("category"), "url", "page_id", F.length("html").cast("bigint").alias("chars"))
    sizes = rows.groupBy("category", "chars").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category")
    run = sizes.withColumns({"upto": F.sum("n").over(w.orderBy("chars")), "c": F.sum("n").over(w)}).withColumn("r", F.floor((F.col("c") - 1) / 2) + 1)
    middle = run.where((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("n") < F.col("r"))).select("category", "chars", (F.col("r") - F.col("upto") + F.col("n")).alias("r"))
    of = rows.join(middle, ["category", "chars"])
    return of.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("page_id"))).where("k = r").select("category", "url", "chars")


@query("""SELECT doc_id, v AS text FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN '—' WHEN 2 THEN 'NaN' WHEN 3 THEN '---' WHEN 4 THEN 'null' ELSE coalesce(source, '') END AS v FROM documents)
WHERE trim(v) NOT IN ('', '—') AND upper(trim(v)) <> 'NAN' AND replace(trim(v), '-', '') <> ''""")
def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    value = F.when(n % 7 == 0, " ").when(n % 7 == 1, "—").when(n % 7 == 2, "NaN").when(n % 7 == 3, "---").when(n % 7 == 4, "null").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("text")).where(~web.placeholder(F.col("text")))


@query("SELECT event_id, 'wfs:' || event_type || ':' || CASE WHEN event_id % 4 = 0 THEN CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) ELSE 'id-' || event_id END AS row_key FROM events")
def live_row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    ident = F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit("id-"), n.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", web.row_key(F.lit("wfs"), F.col("event_type"), ident, index).alias("row_key"))
