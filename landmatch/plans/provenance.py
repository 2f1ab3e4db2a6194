"""Queries of sources and their state: names, groups, licences, freshness, decisions, addresses and dates of services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions import dates, provenance, web
from landmatch.plans.base import query, table
from landmatch.sources import readers, sinks

HOST_SQL = "'s' || s_suppkey % 7 || '.example.org'"


@query(f"""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN {HOST_SQL} || ' (vg:t' || s_suppkey || ')' WHEN 1 THEN {HOST_SQL} || ' (c' || s_suppkey || ')' WHEN 2 THEN {HOST_SQL} WHEN 3 THEN 'Office (set, layer)' WHEN 4 THEN 'Office' ELSE 'https://' || {HOST_SQL} || '/a' END AS name FROM supplier""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s, host = k.cast("string"), F.concat(F.lit("https://s"), (k % 7).cast("string"), F.lit(".example.org/"))
    url = F.when(k % 6 == 0, F.concat(host, F.lit("wfs?service=WFS&typeNames=vg%3At"), s)).when(k % 6 == 1, F.concat(host, F.lit("x/collections/c"), s, F.lit("/items"))).otherwise(F.concat(host, F.lit("a")))
    provider = F.when(k % 6 < 3, "HTTP").when(k % 6 < 5, "Office").otherwise("")
    dataset = F.when(k % 6 == 2, "GeoJSON").when(k % 6 == 3, "set")
    name = provenance.source_name(provider, dataset, F.when(k % 6 == 3, "layer"), F.lit(""), url)
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'preset:bkg_vg25' WHEN 1 THEN 'preset:own' WHEN 2 THEN 'preset:bkg_vg25' WHEN 3 THEN 'download:https://a.org/x?y=' || s_suppkey WHEN 4 THEN 'download:https://a.org/' ELSE 'download:missing:area-' || s_suppkey END AS grp,
CASE s_suppkey % 6 WHEN 2 THEN 'preset:bkg_vg25' WHEN 3 THEN 'download:https://a.org/x?y=' || s_suppkey WHEN 4 THEN 'download:https://a.org/' ELSE 'fallback:area-' || s_suppkey END AS plain FROM supplier""")
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    profile = F.when(k % 6 == 0, F.concat(F.lit("bkg_vg25_"), k.cast("string"))).when(k % 6 == 1, "own")
    url = F.when(k % 6 == 2, " https://daten.gdz.bkg.bund.de/produkte/VG25_EBENEN/a.zip ").when(k % 6 == 3, F.concat(F.lit("HTTPS://A.org/x?y="), k.cast("string"))).when(k % 6 == 4, "https://a.org").when(k % 6 == 5, "no address")
    area = F.concat(F.lit("area-"), k.cast("string"))
    mode = F.when(k % 6 < 2, "profile").otherwise("direct")
    both = provenance.source_group(mode, profile, url, area), provenance.source_group(F.lit("direct"), profile, url, area, "fallback:")
    return table(spark, sf_dir, "supplier").select("s_suppkey", both[0].alias("grp"), both[1].alias("plain"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'dl_de_zero_20' WHEN 1 THEN 'dl_de_by_20' WHEN 2 THEN 'dl_de_by_20' END AS licence, CASE page_id % 4 WHEN 0 THEN 'yes_waiver' WHEN 1 THEN 'yes_waiver' WHEN 2 THEN 'no' END AS compatible FROM pages""")
def licences_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    host = F.when(n % 4 == 0, "https://gdi.berlin.de").when(n % 4 == 1, "https://isk.geobasis-bb.de").when(n % 4 == 2, "https://api.hamburg.de").otherwise("https://example.org")
    found = web.licence_of(F.concat(host, F.lit("/"), n.cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", found["id"].alias("licence"), found["compatible"].alias("compatible"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'HTTP' END AS provider, CASE n_nationkey % 3 WHEN 0 THEN 'set' WHEN 1 THEN 'GeoJSON' ELSE 'WFS GML' END AS dataset, CASE WHEN n_nationkey % 5 = 0 THEN 'custom' WHEN n_nationkey % 2 = 0 THEN 'dl_de_by_20' ELSE 'unknown' END AS licence,
CASE WHEN n_nationkey % 2 = 0 THEN 'no' ELSE 'unknown' END AS compatible, CASE WHEN n_nationkey % 4 = 0 THEN 'Declared CRS: EPSG:25832' END AS note FROM nation""")
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    fields = ("layer", "provider", "dataset", "public_url", "download_url", "licence", "licence_url", "compatible", "note")
    record = lambda **known: F.struct(*[known.get(f, none).alias(f) for f in fields])
    previous = record(provider=F.when(n % 2 == 0, F.col("n_name")))
    configured = record(provider=none, dataset=F.when(n % 3 == 0, "set"), licence=F.when(n % 5 == 0, "custom"), public_url=F.lit("https://example.org"))
    url = F.when(n % 2 == 0, "https://api.hamburg.de/x").otherwise("https://example.org/x")
    merged = provenance.provenance_record(previous, configured, url, F.when(n % 3 == 1, "geojson").otherwise("gml"), F.when(n % 4 == 0, "EPSG:25832"))
    return table(spark, sf_dir, "nation").select("n_nationkey", merged.alias("m")).select("n_nationkey", "m.provider", "m.dataset", "m.licence", "m.compatible", "m.note")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' WHEN event_id % 5 = 0 THEN 'p' ELSE CASE WHEN event_id % 2 = 0 THEN 'd' END END AS "primary", CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'd' END END AS "secondary" FROM events""")
def freshness_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    at = lambda k, v: F.when(n % k == 0, v).otherwise(" ")
    return table(spark, sf_dir, "events").select("event_id", provenance.freshness(at(3, " u"), at(5, "p"), at(2, "d")).alias("f")).select("event_id", "f.*")


@query("""SELECT event_id, CASE WHEN NOT f AND e AND m AND d THEN 'hit' WHEN f THEN 'forced-refresh' WHEN m THEN 'miss' ELSE 'stale' END AS decision, CASE WHEN NOT f AND e AND m AND d THEN 'source_updated_at_unchanged' WHEN f THEN 'force_flag' WHEN NOT e THEN 'missing_geometry' ELSE 'source_updated_at_changed' END AS reason,
CASE WHEN NOT f AND e AND m AND d THEN 'reuse' ELSE 'refresh' END AS action FROM (SELECT event_id, event_id % 5 = 0 AS f, event_id % 3 <> 0 AS e, event_id % 2 = 0 AS m, event_id % 7 <> 0 AS d FROM events)""")
def reuse_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    known = F.when(n % 2 == 0, " 2024-01-01").when(n % 4 == 1, "2023-01-01")
    found = provenance.reuse_decision(n % 5 == 0, n % 3 != 0, known, F.lit("2024-01-01 "), F.when(n % 7 != 0, "x").otherwise(" "))
    return table(spark, sf_dir, "events").select("event_id", found.alias("d")).select("event_id", "d.*")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 2 = 0) THEN 'success' WHEN event_id % 5 = 0 THEN 'compare_failed' ELSE 'failed_no_cache' END AS status,
CASE WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 4 = 1 OR event_id % 6 > 0 THEN CASE WHEN event_id % 6 >= 2 THEN 'streak_warning' ELSE 'fallback' END END AS alert FROM events""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch states of steps, and alerts on downloads."""
    n = F.col("event_id")
    status = provenance.branch_status(F.when(n % 3 == 0, "ok").when(n % 3 == 1, "skipped").otherwise("fail"), n % 2 == 0, F.when(n % 5 == 0, "compare:a").otherwise("osm:download"))
    alert = provenance.download_alert(F.when(n % 4 == 0, "failed_no_cache").otherwise("success"), F.when(n % 4 == 1, "fallback_artifact"), F.when(n % 6 > 0, n % 6))
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), alert.alias("alert"))


@query("""SELECT page_id, 'https://h.org/wfs?service=WFS&request=GetCapabilities' || CASE WHEN page_id % 2 = 0 THEN '&version=2.0.0' ELSE '' END AS capabilities, CASE WHEN page_id % 3 <> 0 THEN 'https://h.org/v1/collections/c' || page_id END AS collection,
'https://h.org/md?id=' || page_id || '&x=1' AS metadata, page_id % 2 = 0 AS wfs, page_id % 3 = 0 AS again FROM pages""")
def service_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    s = n.cast("string")
    service = F.concat(F.lit("https://h.org/wfs?request=GetFeature"), F.when(n % 2 == 0, "&version=2.0.0").otherwise(""), F.lit("&typeName=a"))
    items = F.when(n % 3 == 0, "https://h.org/v1/items").otherwise(F.concat(F.lit("https://h.org/v1/collections/c"), s, F.lit("/items?f=json")))
    xml = F.concat(F.lit("<a><inspire_common:URL> https://h.org/md?id="), s, F.lit("&amp;x=1 </inspire_common:URL></a>"))
    error = F.when(n % 3 == 0, "Error: ECONNRESET").otherwise("Error: 404")
    return table(spark, sf_dir, "pages").select(
        "page_id", web.capabilities_url(service).alias("capabilities"), web.collection_url(items).alias("collection"), web.metadata_url(xml).alias("metadata"),
        provenance.likely_wfs(F.when(n % 2 == 0, service).otherwise(items)).alias("wfs"), web.transient(error).alias("again"),
    )


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2024-02-01' WHEN 1 THEN '2021-01-01' WHEN 2 THEN '2022-01-01' END || 'T00:00:00.000Z' AS updated, CASE page_id % 4 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2020-01-01' END || 'T00:00:00.000Z' AS published FROM pages""")
def capabilities_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 4
    first = "<x:Published>2020-01-01</x:Published><x:date>2019-01-01</x:date><x:LastUpdate>"
    xml = F.when(n == 0, f"<r>{first}2024-02-01</x:LastUpdate><x:modified>2025-01-01</x:modified></r>").when(n == 1, "<r><date>2021-01-01</date><issued>2020-01-01</issued><revision>2023-01-01</revision></r>").when(n == 2, "<r><title>2020</title><date>soon</date><dateStamp>2022-01-01</dateStamp></r>").otherwise("<r><title>a</title></r>")
    return table(spark, sf_dir, "pages").select("page_id", web.capabilities_dates(xml).alias("d")).select("page_id", "d.*")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '2024-0' || (page_id % 9 + 1) || '-01T00:00:00Z' END AS ends, CASE WHEN page_id % 3 = 0 THEN 'No such type ' || page_id END AS failure, page_id % 4 <> 3 AND page_id % 5 <> 0 AS sent FROM pages""")
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection's last day, an exception's text, and whether a query may be sent: to a known server, up to a length."""
    n = F.col("page_id")
    s = n.cast("string")
    body = F.when(n % 2 == 0, F.concat(F.lit('{"extent":{"temporal":{"interval":[["2000-01-01",'), F.concat(F.lit('"2024-0'), (n % 9 + 1).cast("string"), F.lit('-01T00:00:00Z"')), F.lit("]]}}}"))).otherwise('{"extent":{}}')
    xml = F.when(n % 3 == 0, F.concat(F.lit("<ows:Exception><ows:ExceptionText> No such type "), s, F.lit("\n</ows:ExceptionText></ows:Exception>"))).otherwise("<ok/>")
    text = F.when(n % 5 == 0, F.repeat(F.lit("x"), 48_001)).otherwise(F.repeat(F.lit("x"), 48_000))
    host = F.when(n % 4 == 3, "other.org").otherwise("overpass.org")
    return table(spark, sf_dir, "pages").select("page_id", web.interval_end(body).alias("ends"), web.wfs_exception(xml).alias("failure"), web.may_send(host, text, ["overpass.org"]).alias("sent"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(CAST(ts AS DATE), '%Y-%m-%d') || 'T00:00:00.000Z' WHEN 4 THEN NULL WHEN 2 THEN strftime(date_trunc('second', ts) - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.000Z' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS instant,
'germany-' || strftime(ts, '%y%m%d') || '.osm.pbf' AS extract_name FROM events""")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, UTC, offset and zoneless times; every fifth is none."""
    n, second = F.col("event_id"), F.substring(F.col("ts").cast("string"), 1, 19)
    iso = F.replace(second, F.lit(" "), F.lit("T"))
    text = F.when(n % 5 == 0, F.substring(second, 1, 10)).when(n % 5 == 1, F.concat(iso, F.lit("Z"))).when(n % 5 == 2, F.concat(iso, F.lit("+02:30"))).when(n % 5 == 3, second).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", dates.iso_instant(text).alias("instant"), dates.extract_name(F.concat(iso, F.lit("Z"))).alias("extract_name"))


@query("""SELECT o_orderkey, CASE WHEN h < 1 THEN 'minutes' WHEN h < 26 THEN 'hours' WHEN m > 13 THEN 'years' WHEN m >= 12 THEN 'months' ELSE 'days' END AS unit, CAST(CASE WHEN h < 1 THEN mins WHEN h < 26 THEN h WHEN m > 13 THEN m // 12 WHEN m >= 12 THEN m ELSE h // 24 END AS BIGINT) AS n
FROM (SELECT o_orderkey, date_sub('month', o_orderdate, o_orderdate + to_minutes(g)) AS m, g // 60 AS h, g AS mins FROM (SELECT o_orderkey, o_orderdate, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 60 WHEN 1 THEN o_orderkey % 2000 WHEN 2 THEN o_orderkey % 600000 ELSE 540000 + o_orderkey % 300000 END AS BIGINT) AS g FROM orders))""")
def age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("o_orderkey"), F.col("o_orderdate")
    gap = F.when(k % 4 == 0, k % 60).when(k % 4 == 1, k % 2000).when(k % 4 == 2, k % 600_000).otherwise(540_000 + k % 300_000)
    now = ts + F.make_dt_interval(mins=gap.cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.age_bucket(ts, now).alias("a")).select("o_orderkey", "a.*")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.status, a.status) AS status, coalesce(b.at, a.at) AS at FROM (SELECT c_custkey AS k, 'success' AS status, '2024-01-01' AS at FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'failed' END AS status, '2024-01-02' AS at FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""")
def status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's states written over the stored ones; what the run does not say stays."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    stored = k.where("k % 3 <> 0").select("k", F.lit("success").alias("status"), F.lit("2024-01-01").alias("at"))
    run = k.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 == 0, "failed").alias("status"), F.lit("2024-01-02").alias("at"))
    return sinks.merged_metadata(stored, run, ["k"])


@query("SELECT event_id AS seq, 'run-' || user_id AS run_id, event_type AS kind FROM events WHERE event_id % 3 = 0")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with broken lines, lines without a kind, and blank ones."""
    n = F.col("event_id")
    good = F.concat(F.lit('{"runId":"run-'), F.col("user_id").cast("string"), F.lit('","kind":"'), "event_type", F.lit('","exitCode":'), n.cast("string"), F.lit("}"))
    line = F.when(n % 3 == 0, good).when(n % 6 == 1, "{broken").when(n % 6 == 2, '{"runId":"x"}').otherwise(" ")
    rows = readers.parse_events(table(spark, sf_dir, "events").select(n.alias("seq"), line.alias("value")))
    return rows.select("seq", F.col("runId").alias("run_id"), "kind")
