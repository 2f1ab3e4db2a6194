"""Queries of the run history: log folding, calendar rules, snapshots and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landmatch.functions import dates
from landmatch.operators import history
from landmatch.plans.base import query, stamp, stamp_sql, table


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a run log: one run per user and day."""
    n, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("run_id"), n.alias("seq"), F.col("ts").alias("at"),
        F.when(kind == "signup", "run_start").when(kind == "purchase", "run_end").when(kind == "view", "dataset_end").otherwise("step_end").alias("kind"),
        F.when(n % 4 == 0, "osm:download").when(n % 4 == 1, "extract:areas").when(n % 4 == 2, "compare:all").otherwise("report").alias("step"),
        F.concat(F.lit("area-"), (n % 9).cast("string")).alias("dataset"), F.when(n % 5 == 0, "fail").otherwise("ok").alias("status"), (n * 10).alias("duration_ms"),
    )


LOG_SQL = """WITH log AS (SELECT user_id || '-' || strftime(ts, '%d') AS run_id, event_id AS seq, ts AS t,
  CASE event_type WHEN 'signup' THEN 'run_start' WHEN 'purchase' THEN 'run_end' WHEN 'view' THEN 'dataset_end' ELSE 'step_end' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'osm:download' WHEN 1 THEN 'extract:areas' WHEN 2 THEN 'compare:all' ELSE 'report' END AS step,
  'area-' || event_id % 9 AS dataset, CASE WHEN event_id % 5 = 0 THEN 'fail' ELSE 'ok' END AS status, event_id * 10 AS duration_ms FROM events),
flags AS (SELECT run_id, arg_max(t, seq) FILTER (kind = 'run_start') AS started_at, arg_max(t, seq) FILTER (kind = 'run_end') AS ended_at, arg_max(status, seq) FILTER (kind = 'run_end') AS status,
  arg_max(duration_ms, seq) FILTER (kind = 'run_end') AS duration_ms, count(*) FILTER (kind = 'step_end') AS n_steps, count(*) FILTER (kind = 'dataset_end') AS n_datasets,
  max(t) FILTER (kind = 'dataset_end' AND status = 'ok') AS published_at, coalesce(string_agg(step, ',' ORDER BY seq) FILTER (kind = 'step_end'), '') AS steps,
  bool_or(kind = 'dataset_end' OR (kind = 'step_end' AND step LIKE 'compare:%')) AS c, bool_or(kind = 'step_end' AND step = 'osm:download') AS d, bool_or(kind = 'step_end' AND step LIKE 'extract:%') AS e FROM log GROUP BY run_id),
runs AS (SELECT *, CASE WHEN c THEN 'compare' WHEN d AND e THEN 'all' WHEN e THEN 'extract' WHEN d THEN 'download' ELSE 'unknown' END AS phase FROM flags)"""


@query(f"{LOG_SQL} SELECT run_id, {stamp_sql('started_at')} AS started_at, {stamp_sql('ended_at')} AS ended_at, status, duration_ms, n_steps, n_datasets, steps, phase FROM runs")
def runs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = history.fold_runs(log(spark, sf_dir))
    return runs.select("run_id", stamp(F.col("started_at")).alias("started_at"), stamp(F.col("ended_at")).alias("ended_at"), "status", "duration_ms", "n_steps", "n_datasets", F.array_join(F.transform("steps", lambda s: s["step"]), ",").alias("steps"), "phase")


@query(f"{LOG_SQL} SELECT phase, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok_runs FROM runs GROUP BY phase")
def phase_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.fold_runs(log(spark, sf_dir)).groupBy("phase").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok_runs"))


def _latest(phase: str) -> str:
    return f"(SELECT {stamp_sql('coalesce(ended_at, started_at)')} FROM runs WHERE status = 'ok' AND phase = '{phase}' AND coalesce(ended_at, started_at) IS NOT NULL ORDER BY coalesce(started_at, TIMESTAMP '1970-01-01') DESC, run_id DESC LIMIT 1)"


@query(f"{LOG_SQL} SELECT {_latest('compare')} AS last_compare_ok_at, {_latest('download')} AS last_download_ok_at, (SELECT {stamp_sql('max(published_at)')} FROM runs) AS last_published_at")
def status_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = history.key_figures(history.fold_runs(log(spark, sf_dir)))
    return k.select(*[stamp(F.col(c)).alias(c) for c in k.columns])


BERLIN = "timezone('Europe/Berlin', timezone('UTC', {ts}))"


@query(f"{LOG_SQL} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS runs, min(run_id) AS first_run FROM (SELECT run_id, CAST({BERLIN.format(ts='coalesce(started_at, ended_at)')} AS DATE) AS day FROM runs) WHERE day IS NOT NULL GROUP BY 1")
def berlin_day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = history.runs_by_day(history.fold_runs(log(spark, sf_dir)))
    return days.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("runs"), F.min("run_id").alias("first_run"))


@query(f"""{LOG_SQL} SELECT run_id, coalesce(day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25', false) AS in_window FROM (SELECT run_id, CAST({BERLIN.format(ts='coalesce(started_at, ended_at)')} AS DATE) AS day FROM runs)""")
def timeline_21d(spark: SparkSession, sf_dir: str) -> DataFrame:
    center = F.lit("2024-01-15").cast("date")
    return history.split_by_timeline(history.fold_runs(log(spark, sf_dir)), center).select("run_id", "in_window")


@query(f"SELECT event_id, strftime(CAST(l - CASE WHEN hour(l) < 1 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS DATE), '%Y-%m-%d') AS window_key FROM (SELECT event_id, {BERLIN.format(ts='ts')} AS l FROM events)")
def refresh_window_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format(dates.window_key(F.col("ts")), "yyyy-MM-dd").alias("window_key"))


@query("SELECT o_orderkey, isoyear(d) || '-W' || lpad(CAST(week(d) AS VARCHAR), 2, '0') AS iso_week FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def iso_week_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_week(F.to_date("o_orderdate")).alias("iso_week"))


@query("""SELECT DISTINCT strftime(d, '%Y-%m-%d') AS day, CASE WHEN dayofweek(d) IN (0, 3, 5, 6) THEN strftime(timezone('UTC', timezone('Europe/Berlin', CAST(d AS TIMESTAMP) + INTERVAL 4 HOUR)), '%Y-%m-%d %H:%M:%S.%f') END AS slot
FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)""")
def schedule_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), stamp(dates.schedule_slot(F.col("d"))).alias("slot"))


NOW = "2024-01-15 12:00:00"


@query(f"""SELECT event_id, reason IN ('force', 'cache_missing', 'cache_stale_previous_window') AS should_download, reason FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'force' WHEN event_id % 7 = 0 THEN 'cache_missing'
  WHEN event_id % 13 = 0 THEN 'cache_used_missing_cached_at' WHEN event_id % 17 = 0 THEN 'cache_used_invalid_cached_at' WHEN w = DATE '2024-01-15' THEN 'cache_used_current_window' ELSE 'cache_stale_previous_window' END AS reason
  FROM (SELECT event_id, CAST(l - CASE WHEN hour(l) < 1 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS DATE) AS w FROM (SELECT event_id, {BERLIN.format(ts='ts')} AS l FROM events)))""")
def refresh_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    cached = F.when(n % 13 == 0, " ").when(n % 17 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    found = dates.refresh_decision(n % 11 == 0, n % 7 != 0, cached, F.lit(NOW).cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", found.alias("d")).select("event_id", "d.*")


@query(f"SELECT event_id, epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts) > 5 * 86400000 AS stale FROM events")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.stale(F.col("ts"), F.lit(NOW).cast("timestamp_ntz"), 5).alias("stale"))


@query("SELECT k, strftime(CASE WHEN length(k) = 8 THEN try_strptime(k, '%d%m%Y') END, '%Y-%m-%d') AS day FROM (SELECT lpad(CAST((p_partkey % 40) AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 14 AS VARCHAR), 2, '0') || '2024' AS k FROM part)")
def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    k = F.concat(F.lpad((n % 40).cast("string"), 2, "0"), F.lpad((n % 14).cast("string"), 2, "0"), F.lit("2024"))
    return table(spark, sf_dir, "part").select(k.alias("k")).select("k", F.date_format(dates.strict_date(F.col("k")), "yyyy-MM-dd").alias("day"))


@query("""WITH a AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'fresh' WHEN 'purchase' THEN 'cache_window' WHEN 'error' THEN 'failed' ELSE 'fallback_artifact' END AS outcome FROM events),
i AS (SELECT *, sum(CASE WHEN outcome IN ('fresh', 'cache_window') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM a),
s AS (SELECT *, CAST(sum(CASE WHEN outcome = 'fallback_artifact' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS streak FROM i)
SELECT event_id, outcome, streak, outcome IN ('fresh', 'cache_window') OR (outcome = 'fallback_artifact' AND streak <= 2) AS ok FROM s""")
def fallback_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    cached = kind == "purchase"
    status = F.when(kind.isin("signup", "purchase"), "ok").when(kind == "error", "fail").otherwise("skipped")
    reason = F.when(kind.isin("view", "click"), "fallback_osm_cache_restored")
    attempts = table(spark, sf_dir, "events").select("user_id", "event_id", history.download_outcome(status, cached, reason).alias("outcome"))
    return history.fallback_streaks(attempts, ["user_id"], "event_id").select("event_id", "outcome", "streak", "ok")


@query("""WITH d AS (SELECT o_orderstatus AS area, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY ALL)
SELECT area, strftime(d, '%Y-%m-%d') AS run_id, CASE WHEN d >= DATE '1999-01-01' THEN n * 2 ELSE n END AS n FROM d""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run of the same day replaces its snapshot."""
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("area"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_id")).agg(F.count("*").alias("n"))
    return history.upsert_snapshots(old, old.where("run_id >= '1999-01-01'").withColumn("n", F.col("n") * 2), ["area", "run_id"])


@query("""WITH d AS (SELECT o_orderstatus AS area, year(o_orderdate) AS run_id, count(*) AS n FROM orders GROUP BY ALL)
SELECT area, run_id, n, lag(n) OVER (PARTITION BY area ORDER BY run_id) AS prev_n FROM d""")
def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("area"), F.year("o_orderdate").cast("bigint").alias("run_id")).agg(F.count("*").alias("n"))
    return history.with_previous(runs, ["area"], "run_id", ["n"])


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, coalesce(arg_max(length(text), turn), 0) AS last_chars FROM conversations GROUP BY conv_id""")
def conversation_turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.coalesce(F.max_by(F.length("text"), "turn"), F.lit(0)).cast("bigint").alias("last_chars"))


@query("SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_props_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that passes, however many a user has."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k > 50")
