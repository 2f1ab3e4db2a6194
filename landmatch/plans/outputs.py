"""Queries of what the report shows and stores: links, series, licence table, feature documents, postal candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions import extract, keys, web
from landmatch.operators import report
from landmatch.plans.base import query, table
from landmatch.plans.extraction import AT_ID_SQL, boundaries


@query(f"SELECT o_orderkey AS seq, {AT_ID_SQL} AS at_id FROM orders WHERE o_orderkey % 2 = 1")
def postal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postal boundaries, those without a code too."""
    return boundaries(spark, sf_dir).where(extract.postal_candidates()).select("seq", extract.at_id(F.col("osm_way_id"), F.col("osm_id")).alias("at_id"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN regexp_matches(p_type || CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE '' END, '[0-9]') THEN trim(p_type || CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE '' END) END AS value,
  p_partkey % 4 = 0 OR p_partkey % 5 = 0 AS postal FROM part""")
def link_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with a digit; whether a data set is one of postal codes by its preset or its boundary."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("  "), F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(" "))
    value = keys.link_value(F.when(k % 3 == 0, k.cast("string")).otherwise(text))
    postal = web.is_postal(F.when(k % 4 == 0, "plz-5").when(k % 2 == 0, "text"), F.when(k % 5 == 0, "postal_code").otherwise("administrative"))
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("value"), postal.alias("postal"))


@query(rf"""WITH c AS (SELECT c_custkey AS k, 6 + c_custkey % 90 / 10.0 AS w, 47 + c_custkey % 70 / 10.0 AS s, 0.01 * (1 + c_custkey % 60) AS d FROM customer),
v AS (SELECT *, CASE WHEN k % 4 <> 0 THEN CAST(least(greatest(floor(14 - log2(d * 45) + 0.5), 11), 18) AS INTEGER) || '%2F' || printf('%.6f', s + d / 4) || '%2F' || printf('%.6f', w + d / 2) END AS view, CASE WHEN k % 3 <> 0 THEN k END AS r, CASE WHEN k % 5 <> 0 THEN k END AS g FROM c)
SELECT k, '{web.WEB_EDITOR}#' || concat_ws('&', 'map=' || view, 'id=r' || r, 'disable_features={web.HIDDEN.replace(",", "%2C")}', 'gpx=https%3A%2F%2Fh%2Fa+b%2F' || g || '.json', 'hashtags=ab%26c') AS edit,
  '{web.OBJECT_PAGE}' || r AS browse, '{web.REMOTE_CONTROL}/load_object?relation_members=true&objects=r' || r || '&changeset_hashtags=ab%26c' AS load, '{web.REMOTE_CONTROL}/import?new_layer=true&changeset_hashtags=ab%26c&url=https%3A%2F%2Fh%2Fa%20b%2F' || g || '.json' AS import FROM v""")
def editor_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editor addresses of rows with and without a place, a relation and an official shape."""
    k = F.col("c_custkey")
    d = F.lit(0.01) * (1 + k % 60)
    w, s = F.lit(6) + k % 90 / 10.0, F.lit(47) + k % 70 / 10.0
    here = k % 4 != 0
    box = tuple(F.when(here, c) for c in (w, s, w + d, s + d / 2))
    shape = F.when(k % 5 != 0, F.concat(F.lit("https://h/a b/"), k.cast("string"), F.lit(".json")))
    return table(spark, sf_dir, "customer").select(k.alias("k"), web.editor_links(box, F.when(k % 3 != 0, k), shape, "ab&c").alias("l")).select("k", "l.*")


@query("""WITH r AS (SELECT c_nationkey AS area, CAST(year(o_orderdate) AS VARCHAR) AS run, avg(o_totalprice) AS mean FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 <> 0 AND year(o_orderdate) < 1997 GROUP BY ALL)
SELECT area, run, round(mean, 4) AS mean FROM r UNION ALL SELECT c_nationkey, 'current', round(avg(c_acctbal), 4) FROM customer WHERE c_nationkey NOT IN (SELECT area FROM r) GROUP BY 1""")
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of runs by area; runs of some years and areas have none, and an area without any shows its rows' mean."""
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area"), "c_custkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    runs = orders.groupBy("area", F.year("o_orderdate").alias("run")).agg(F.avg("o_totalprice").alias("mean"))
    known = runs.withColumn("mean", F.when((F.col("area") % 4 != 0) & (F.col("run") < 1997), F.col("mean")).otherwise(F.lit(float("nan"))))
    return report.chart_series(known, people, ["area"], "run", "mean", "c_acctbal").withColumn("mean", F.round("mean", 4))


@query("""WITH m AS (SELECT s_suppkey * 7 % 1000003 AS place, 'a' || s_suppkey AS area, s_nationkey || chr(31) || (s_suppkey % 3) AS merge_key FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT min(place) AS place, merge_key, arg_min(area, place) AS area, string_agg(area, ',' ORDER BY place) AS members FROM m GROUP BY merge_key""")
def licence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence summaries of areas grouped in the order of their first area; every fifth area has none."""
    k = F.col("s_suppkey")
    every = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), k.cast("string")).alias("area"), (k * 7 % 1000003).alias("place"), k, keys.licence_fingerprint(F.col("s_nationkey").cast("string"), (k % 3).cast("string")).alias("merge_key"))
    found = report.licence_table(every.where(k % 5 != 0).select("area", "merge_key"), every.select("area", "place"))
    return found.select("place", "merge_key", "area", F.array_join("members", ",").alias("members"))


@query("""SELECT p_brand AS area, CAST(p_partkey AS VARCHAR) AS key, '{"row":{"key":"' || p_partkey || '","iou":' || p_size || '}' || CASE p_partkey % 3 WHEN 0 THEN ',"candidates":[]' WHEN 1 THEN ',"candidates":[{"osm_type":"way","osm_id":' || p_partkey || '}]' ELSE '' END || '}' AS shard FROM part""")
def feature_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per row, with its candidates: none, an empty list, or one."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("area"), k.cast("string").alias("key"), F.col("p_size").alias("iou"))
    one = F.array(F.struct(F.lit("way").alias("osm_type"), k.alias("osm_id")))
    lists = table(spark, sf_dir, "part").where(k % 3 < 2).select(F.col("p_brand").alias("area"), k.cast("string").alias("key"), F.when(k % 3 == 1, one).otherwise(F.slice(one, 2, 1)).alias("candidates"))
    return report.feature_shards(rows, lists, ["area"], "key")
