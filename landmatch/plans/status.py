"""Queries of the run-status and attempt documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.operators import status
from landmatch.plans.base import query, table

_UPDATES = """u AS (SELECT user_id AS place, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS t, 'run-' || event_id AS run_id, event_type AS said,
  CASE WHEN event_id % 11 = 0 THEN 'start' WHEN event_id % 11 = 1 THEN 'end' WHEN event_id % 3 = 0 THEN 'shared' WHEN event_id % 3 = 1 THEN 'compare' ELSE 'official' END AS op,
  CASE WHEN event_id % 3 = 0 THEN 'step-' || event_id % 4 ELSE 'area-' || event_id % 5 END AS name FROM events)"""


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as updates: one folder per user."""
    n = F.col("event_id")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("place"), (n + 1).cast("long").alias("seq"), at.alias("at"),
        F.when(n % 11 == 0, "start").when(n % 11 == 1, "end").when(n % 3 == 0, "shared").when(n % 3 == 1, "compare").otherwise("official").alias("op"),
        F.when(n % 3 == 0, F.concat(F.lit("step-"), (n % 4).cast("string"))).otherwise(F.concat(F.lit("area-"), (n % 5).cast("string"))).alias("name"),
        F.concat(F.lit("run-"), n.cast("string")).alias("run_id"), F.when(n % 11 == 1, F.concat(F.substring(at, 1, 10), F.lit("T00:00:00.000Z"))).otherwise(at).alias("started_at"),
        F.col("event_type").alias("status"), status.branch(F.col("event_type"), usedCache=n % 2 == 0).alias("branch"),
    )


def _shown(documents: DataFrame) -> DataFrame:
    """What the documents say, read back from their JSON."""
    d = documents.select("place", status.parsed(F.col("document")).alias("d"))
    tell = lambda op, name, b: F.concat(F.lit(f"{op}/"), name, F.lit("="), b["status"], F.lit("@"), b["updatedAt"], F.lit(" "), b["usedCache"].cast("string"))

    def of_areas(op: str, field: str):
        held = F.filter(F.map_entries("d.areas"), lambda e: e["value"][field].isNotNull())
        return F.transform(held, lambda e: tell(op, e["key"], e["value"][field]))

    each = F.concat(of_areas("compare", "compare"), of_areas("official", "officialDownload"), F.transform(F.map_entries("d.shared"), lambda e: tell("shared", e["key"], e["value"])))
    return d.select("place", F.col("d.runId").alias("run_id"), F.col("d.startedAt").alias("started_at"), F.col("d.updatedAt").alias("updated_at"), F.col("d.inProgress").alias("in_progress"), F.col("d.status").alias("status"), F.array_join(F.sort_array(each), ",").alias("branches"))


_SHOWN = f"""WITH {_UPDATES},
l AS (SELECT *, coalesce(max(seq) FILTER (op = 'start') OVER (PARTITION BY place), -1) AS since FROM u),
d AS (SELECT place, arg_max(t, seq) AS updated_at, arg_max(run_id, seq) FILTER (op = 'start') AS s_run, arg_max(t, seq) FILTER (op = 'start') AS s_at, arg_max(run_id, seq) FILTER (op = 'end' AND seq > since) AS e_run,
  arg_max(substr(t, 1, 10) || 'T00:00:00.000Z', seq) FILTER (op = 'end' AND seq > since) AS e_at, arg_max(said, seq) FILTER (op = 'end' AND seq > since) AS status, arg_min(t, seq) FILTER (op NOT IN ('start', 'end')) AS f_at FROM l GROUP BY place),
b AS (SELECT place, op || '/' || name || '=' || arg_max(said || '@' || t || CASE WHEN seq % 2 = 0 THEN ' true' ELSE ' false' END, seq) AS one FROM l WHERE seq > since AND op NOT IN ('start', 'end') GROUP BY place, op, name),
g AS (SELECT place, string_agg(one, ',' ORDER BY one) AS branches FROM b GROUP BY place)
SELECT place, coalesce(e_run, s_run, 'unknown-' || epoch_ms(CAST(rtrim(f_at, 'Z') AS TIMESTAMP))) AS run_id, coalesce(e_at, s_at, f_at) AS started_at, updated_at, e_run IS NULL AS in_progress, status, coalesce(branches, '') AS branches FROM d LEFT JOIN g USING (place)"""


@query(_SHOWN)
def run_status_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(status.documents(_updates(spark, sf_dir), "place"))


@query(_SHOWN)
def run_status_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the first updates, with the later ones written over them: the same as all at once."""
    updates = _updates(spark, sf_dir)
    early = F.col("at") < "2024-01-16"
    ordered = updates.withColumn("_early", early)
    last_early = ordered.where("_early").groupBy("place").agg(F.max("seq").alias("_cut"))
    split = updates.join(last_early, "place", "left").withColumn("_first", F.col("seq") <= F.coalesce("_cut", F.lit(0)))
    stored = status.documents(split.where("_first").drop("_cut", "_first"), "place")
    return _shown(status.rewritten(stored, split.where("not _first").drop("_cut", "_first"), "place"))


@query("""WITH a AS (SELECT user_id AS place, event_id AS seq, event_id // 40 % 7 AS run_id, CASE WHEN event_id % 3 = 0 THEN 'fresh' ELSE 'fallback' END AS attempt,
  CASE event_type WHEN 'signup' THEN 'fresh' WHEN 'purchase' THEN 'cache_window' WHEN 'error' THEN 'failed' ELSE 'fallback_artifact' END AS outcome, CASE WHEN event_id % 4 > 0 THEN 'error ' || event_id END AS message FROM events),
l AS (SELECT *, last_value(run_id) OVER (PARTITION BY place ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS of FROM a),
c AS (SELECT *, coalesce(max(seq) FILTER (run_id <> of) OVER (PARTITION BY place), -1) AS since FROM l),
g AS (SELECT place, place % 4 AS n, arg_max(outcome, seq) FILTER (attempt = 'fresh') AS fo, arg_max(outcome, seq) FILTER (attempt = 'fallback') AS bo,
  arg_max(coalesce(message, ''), seq) FILTER (attempt = 'fresh') AS fm, arg_max(coalesce(message, ''), seq) FILTER (attempt = 'fallback') AS bm, any_value(of) AS run_id FROM c WHERE seq > since GROUP BY place),
k AS (SELECT *, CASE WHEN fo IN ('fresh', 'cache_window') THEN 'f' WHEN bo IN ('fresh', 'cache_window') THEN 'b' WHEN bo = 'fallback_artifact' THEN 'held' ELSE 'lost' END AS way, nullif(fm, '') AS f, nullif(bm, '') AS b FROM g)
SELECT place, CAST(run_id AS BIGINT) AS run_id, CASE way WHEN 'f' THEN fo WHEN 'b' THEN bo WHEN 'held' THEN bo ELSE 'failed' END AS outcome, way IN ('f', 'b') OR (way = 'held' AND n < 2) AS ok,
  CAST(CASE way WHEN 'held' THEN n + 1 WHEN 'lost' THEN n ELSE 0 END AS BIGINT) AS streak,
  CASE WHEN way = 'held' AND n < 2 THEN f WHEN way = 'held' THEN coalesce(f, b, 'OSM fallback cache used ' || (n + 1) || ' consecutive runs (limit 2)') WHEN way = 'lost' THEN coalesce(b, f, 'OSM PBF download failed on fresh and fallback attempts') END AS error_message FROM k""")
def download_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision over the last run's attempts of every user, some of whose runs come back after others."""
    n, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("place"), n.alias("seq"), (F.floor(n / 40) % 7).cast("long").alias("run_id"), F.when(n % 3 == 0, "fresh").otherwise("fallback").alias("attempt"),
        F.when(kind == "signup", "fresh").when(kind == "purchase", "cache_window").when(kind == "error", "failed").otherwise("fallback_artifact").alias("outcome"), F.when(n % 4 > 0, F.concat(F.lit("error "), n.cast("string"))).alias("error_message"),
    )
    decided = status.attempts(rows, "place").select("place", "run_id", status.policy(F.col("place") % 4, F.col("fresh"), F.col("fallback")).alias("p"))
    return decided.select("place", "run_id", "p.*")
