"""Queries of the key dictionary, the relation resolver and grouped sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions import geometry, keys
from landmatch.operators import dictionary, reconcile, resolver
from landmatch.plans.base import query, table


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as register rows. Types and numbers follow from the key, some of them wrong on purpose."""
    k = F.col("p_partkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    zero = lambda c, *types: F.when(F.col("satzart").isin(*types) & (k % 10 != 3), F.lit(0)).otherwise(c)
    rows = table(spark, sf_dir, "part").withColumn("satzart", F.concat((k % 7 + 1).cast("string"), F.lit("0")))
    return rows.select(
        "satzart", F.when(k % 23 == 0, "31022024").otherwise("31012024").alias("snapshot_date"), pad(k % 18, 2).alias("land"), pad(zero(k % 4, "10"), 1).alias("rb"), pad(zero(k % 31, "10", "20"), 2).alias("kreis"),
        pad(zero(k % 97, "10", "20", "30", "40"), 4).alias("vb"), pad(zero(k % 211, "10", "20", "30", "40", "50"), 3).alias("gem"), F.col("p_name").alias("name"), k.alias("line"),
    )


def _zero(e: str, *types: str) -> str:
    return f"CASE WHEN satzart IN ({', '.join(repr(t) for t in types)}) AND k % 10 <> 3 THEN 0 ELSE {e} END"


REGISTER_SQL = f"""WITH base AS (SELECT p_partkey AS k, (p_partkey % 7 + 1) || '0' AS satzart, p_name AS name FROM part),
reg AS (SELECT satzart, CASE WHEN k % 23 = 0 THEN '31022024' ELSE '31012024' END AS snapshot_date, lpad(CAST(k % 18 AS VARCHAR), 2, '0') AS land, CAST({_zero('k % 4', '10')} AS VARCHAR) AS rb, lpad(CAST({_zero('k % 31', '10', '20')} AS VARCHAR), 2, '0') AS kreis,
  lpad(CAST({_zero('k % 97', '10', '20', '30', '40')} AS VARCHAR), 4, '0') AS vb, lpad(CAST({_zero('k % 211', '10', '20', '30', '40', '50')} AS VARCHAR), 3, '0') AS gem, name, k AS line FROM base)"""
NO_STATE = "land NOT BETWEEN '01' AND '16'"
ZERO_SQL = " ".join(f"UNION ALL SELECT satzart, land, line, 'satzart{t}_{n}_zero' FROM reg WHERE satzart = '{t}' AND {n} <> '{'0' * dictionary.WIDTHS[n]}'" for t, names in dictionary.ZERO_FIELDS.items() for n in names)
ENTRIES_SQL = f"""{REGISTER_SQL}, entries AS (SELECT CASE satzart WHEN '10' THEN 'states' WHEN '20' THEN 'regions' WHEN '40' THEN 'districts' WHEN '50' THEN 'associations' ELSE 'municipalities_by_ars' END AS map_name,
  CASE satzart WHEN '10' THEN land WHEN '20' THEN land || rb WHEN '40' THEN land || rb || kreis WHEN '50' THEN land || rb || kreis || vb ELSE land || rb || kreis || vb || gem END AS key, name, line FROM reg WHERE satzart IN ('10', '20', '40', '50', '60')
  UNION ALL SELECT 'municipalities_by_ags', land || rb || kreis || gem, name, line FROM reg WHERE satzart = '60'),
maps AS (SELECT map_name, key, arg_min(name, line) AS name FROM entries GROUP BY ALL)"""


@query(f"""{REGISTER_SQL}, states AS (SELECT DISTINCT land FROM reg WHERE satzart = '10' AND NOT {NO_STATE})
SELECT satzart, land, line, 'unexpected_satzart' AS rule FROM reg WHERE satzart NOT IN ('10', '20', '30', '40', '50', '60')
UNION ALL SELECT satzart, land, line, 'invalid_snapshot_date' FROM reg WHERE satzart <> '70' AND snapshot_date = '31022024'
UNION ALL SELECT satzart, land, line, 'invalid_land_code' FROM reg WHERE satzart <> '70' AND land <> '00' AND {NO_STATE}
UNION ALL SELECT satzart, land, line, 'kreis_invalid_land' FROM reg WHERE satzart = '40' AND {NO_STATE} {ZERO_SQL}
UNION ALL SELECT '10', lpad(CAST(s AS VARCHAR), 2, '0'), 0, 'missing_bundesland' FROM range(1, 17) r(s) WHERE lpad(CAST(s AS VARCHAR), 2, '0') NOT IN (SELECT land FROM states)
UNION ALL SELECT '10', '', 0, 'bundesland_count' FROM (SELECT count(*) AS n FROM states) WHERE n <> 16
UNION ALL SELECT satzart, land, line, 'orphan_land_reference' FROM reg WHERE satzart IN ('40', '50', '60') AND land <> '00' AND land NOT IN (SELECT land FROM states)
UNION ALL SELECT satzart, land, line, 'gemeinde_orphan_land' FROM reg WHERE satzart = '60' AND land NOT IN (SELECT land FROM states)""")
def hierarchy_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.hierarchy_errors(register(spark, sf_dir))


@query(f"{ENTRIES_SQL} SELECT map_name, key, name FROM maps")
def lookup_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.lookup_maps(dictionary.lookup_entries(register(spark, sf_dir)))


@query(f"{ENTRIES_SQL} SELECT e.map_name, e.key, m.name AS previous, e.name AS incoming, line FROM entries e JOIN maps m ON e.map_name = m.map_name AND e.key = m.key WHERE e.name <> m.name")
def lookup_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.lookup_conflicts(dictionary.lookup_entries(register(spark, sf_dir)))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_name, key, name, year): customers with an order in a year."""
    k = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "districts").otherwise("municipalities_by_ags").alias("map_name"), F.when(k % 2 == 0, F.lpad(k.cast("string"), 5, "0")).otherwise(F.lpad((k * 101).cast("string"), 8, "0")).alias("key"), F.year("o_orderdate").alias("year"))
    return rows.distinct().withColumn("name", F.concat_ws("@", "key", F.col("year").cast("string")))


YEARLY_SQL = """WITH y AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 'districts' ELSE 'municipalities_by_ags' END AS map_name, CASE WHEN o_custkey % 2 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0') ELSE lpad(CAST(o_custkey * 101 AS VARCHAR), 8, '0') END AS key, year(o_orderdate) AS year FROM orders),
top AS (SELECT max(year) AS year FROM y), latest AS (SELECT y.* FROM y JOIN top USING (year)), annual AS (SELECT y.* FROM y JOIN top ON y.year < top.year),
gone AS (SELECT map_name, key, key || '@' || max(year) AS name, max(year) AS last_year FROM annual a WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.map_name = a.map_name AND l.key = a.key)
  AND NOT (map_name = 'districts' AND EXISTS (SELECT 1 FROM latest l WHERE l.map_name = 'municipalities_by_ags' AND substr(l.key, 1, 5) = a.key)) GROUP BY map_name, key)"""


def split_years(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = yearly(spark, sf_dir)
    top = rows.agg(F.max("year").alias("_top"))  # one row
    both = rows.join(F.broadcast(top), F.col("year") <= F.col("_top"))
    return both.where("year < _top").drop("_top"), both.where("year = _top").drop("_top")


@query(f"{YEARLY_SQL} SELECT map_name, key, name, CAST(last_year AS INTEGER) AS last_year FROM gone")
def obsolete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.obsolete(*split_years(spark, sf_dir))


@query(f"{YEARLY_SQL} SELECT coalesce(l.map_name, g.map_name) AS map_name, coalesce(l.key, g.key) AS key, CASE WHEN l.key IS NOT NULL THEN l.key || '@' || l.year ELSE g.name END AS name, CASE WHEN l.key IS NULL THEN CAST(g.last_year AS INTEGER) END AS last_year FROM latest l FULL OUTER JOIN gone g ON l.map_name = g.map_name AND l.key = g.key")
def latest_over_obsolete(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual, latest = split_years(spark, sf_dir)
    return reconcile.latest_over_obsolete(latest, dictionary.obsolete(annual, latest), ["map_name", "key"])


@query(f"""{ENTRIES_SQL}, names AS (SELECT key AS segment, min(name) AS name FROM maps WHERE map_name <> 'municipalities_by_ags' GROUP BY 1), ks AS (SELECT key FROM maps WHERE map_name = 'municipalities_by_ars')
SELECT ks.key, CAST(l AS INTEGER) AS level, substr(ks.key, 1, CAST(l AS INTEGER)) AS segment, n.name FROM ks CROSS JOIN (VALUES (2), (3), (5), (9), (12)) v(l) LEFT JOIN names n ON n.segment = substr(ks.key, 1, CAST(l AS INTEGER))""")
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = dictionary.lookup_maps(dictionary.lookup_entries(register(spark, sf_dir)))
    names = maps.where("map_name <> 'municipalities_by_ags'").groupBy(F.col("key").alias("segment")).agg(F.min("name").alias("name"))
    return dictionary.segment_names(maps.where("map_name = 'municipalities_by_ars'"), names)


@query(f"""{ENTRIES_SQL} SELECT ags, ars, name FROM (SELECT substr(key, 1, 5) || substr(key, 10, 3) AS ags, key AS ars, name, row_number() OVER (PARTITION BY substr(key, 1, 5) || substr(key, 10, 3) ORDER BY length(name) DESC, key) AS n FROM maps WHERE map_name = 'municipalities_by_ars') WHERE n = 1""")
def reverse_by_ags(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = dictionary.lookup_maps(dictionary.lookup_entries(register(spark, sf_dir))).where("map_name = 'municipalities_by_ars'")
    return dictionary.reverse_by_ags(maps.select(F.col("key").alias("ars"), "name", F.length("name").alias("year")))


@query("""SELECT kind, id, name, rank FROM (SELECT 'ags' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_name = 'red' THEN 0 WHEN trim(split_part(p_name, ',', 1)) = 'red' THEN 1 WHEN starts_with(p_name, 'red,') OR starts_with(p_name, 'red ') THEN 2 WHEN starts_with(trim(split_part(p_name, ',', 1)), 'red') THEN 47 WHEN contains(p_name, 'red') THEN 60 END AS rank FROM (SELECT p_partkey, lower(p_name) AS p_name FROM part))
WHERE rank IS NOT NULL ORDER BY rank, name, kind, length(id), id LIMIT 200""")
def name_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    geometry.register(spark)
    entries = table(spark, sf_dir, "part").select(F.lit("ags").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.lower("p_name").alias("name"))
    return dictionary.search_names(entries, "red").select("kind", "id", "name", "rank")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("relation_id"), F.concat(F.lit("set-"), (k % 3).cast("string")).alias("dataset"), (k % 7).cast("string").alias("area_id"), k.cast("string").alias("feature_key"), F.lit("n").alias("feature_name"))


PLACES_SQL = "WITH p AS (SELECT DISTINCT l_partkey AS relation_id, 'set-' || l_suppkey % 3 AS dataset, CAST(l_suppkey % 7 AS VARCHAR) AS area_id, CAST(l_suppkey AS VARCHAR) AS feature_key FROM lineitem)"


@query(f"{PLACES_SQL} SELECT relation_id, string_agg(dataset || ':' || area_id || ':' || feature_key, ',' ORDER BY dataset, area_id, feature_key) AS candidates FROM p GROUP BY relation_id")
def relation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = resolver.relation_index(places(spark, sf_dir))
    return index.select("relation_id", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["dataset"], c["area_id"], c["feature_key"])), ",").alias("candidates"))


@query(f"""{PLACES_SQL} SELECT p_partkey AS relation_id, CASE WHEN n IS NULL THEN 'not_found' WHEN f = 1 THEN 'redirect' ELSE 'list' END AS kind, CASE WHEN f = 1 THEN k END AS target
FROM part LEFT JOIN (SELECT relation_id, count(*) AS n, count(*) FILTER (dataset = 'set-1') AS f, min(feature_key) FILTER (dataset = 'set-1') AS k FROM p GROUP BY relation_id) ON p_partkey = relation_id""")
def relation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("relation_id")).join(resolver.relation_index(places(spark, sf_dir)), "relation_id", "left")
    return asked.select("relation_id", resolver.decision(F.col("candidates"), F.lit("set-1 ")).alias("d")).select("relation_id", "d.kind", F.col("d.target.feature_key").alias("target"))


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) > 1 AND max(l_suppkey % 3 = 0) AND max(l_suppkey % 3 = 1) THEN 'choose' ELSE 'open' END AS action, CAST(min(l_linenumber * 1000000 + l_suppkey) % 1000000 AS BIGINT) AS first_key FROM lineitem GROUP BY l_orderkey""")
def click_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    hits = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1_000_000 + k).alias("drawn"), k.alias("feature_key"), F.when(k % 3 == 0, "official_only").when(k % 3 == 1, "unmatched_osm").otherwise("matched").alias("category"))
    return resolver.click_decision(hits, ["l_orderkey"], "drawn")


@query("""SELECT n_regionkey || chr(31) || coalesce(CASE WHEN s_nationkey % 4 <> 0 THEN CAST(s_nationkey % 4 AS VARCHAR) END, '') AS licence, count(*) AS sources, arg_min(s_name, s_suppkey) AS first_source, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS areas
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def licence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_nationkey") % 4
    key = keys.licence_fingerprint(F.col("n_regionkey").cast("string"), F.when(k != 0, k.cast("string")))
    grouped = rows.groupBy(key.alias("licence")).agg(F.count("*").alias("sources"), F.min_by("s_name", "s_suppkey").alias("first_source"), F.array_sort(F.collect_list("s_suppkey")).alias("a"))
    return grouped.select("licence", "sources", "first_source", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("areas"))


@query("SELECT n_name AS name, r_name AS href, min(s_suppkey) AS first_seen FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("href"))
    return table(spark, sf_dir, "supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("name", "href").agg(F.min("s_suppkey").alias("first_seen"))
