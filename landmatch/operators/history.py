"""Run logs folded into runs, days and key figures; snapshots; streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmatch.functions.dates import local_day


def steps_match(column: str, *prefixes: str, exact: tuple[str, ...] = ()) -> Column:
    hit = F.col(column).isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        hit = hit | F.col(column).startswith(p)
    return F.coalesce(hit, F.lit(False))


def is_download(step: str = "step") -> Column:
    return steps_match(step, "download:", "bkg:download", exact=("osm:download",))


def is_extract(step: str = "step") -> Column:
    return steps_match(step, "extract:", "osm:extract", exact=("bkg:extract",))


def is_compare(step: str = "step") -> Column:
    return steps_match(step, "compare:")


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per run. events: kind, run_id, at, seq (order in the log), step, dataset, status, duration_ms.

    Later events of a kind override earlier ones; step and data set summaries are lists in the log's order.
    """
    kind = F.col("kind")
    last = lambda value, k: F.max_by(F.when(kind == k, F.col(value)), F.when(kind == k, F.col("seq")))
    listed = lambda k, name: F.transform(F.array_sort(F.collect_list(F.when(kind == k, F.struct("seq", name, "status", "duration_ms", "at")))), lambda x: x.dropFields("seq"))
    ended = lambda what: F.coalesce(F.bool_or(what & (kind == "step_end")), F.lit(False))
    runs = events.groupBy("run_id").agg(
        last("at", "run_start").alias("started_at"),
        last("at", "run_end").alias("ended_at"),
        last("status", "run_end").alias("status"),
        last("duration_ms", "run_end").alias("duration_ms"),
        listed("step_end", "step").alias("steps"),
        listed("dataset_end", "dataset").alias("datasets"),
        F.count_if(kind == "step_end").alias("n_steps"),
        F.count_if(kind == "dataset_end").alias("n_datasets"),
        F.max(F.when((kind == "dataset_end") & (F.col("status") == "ok"), F.col("at"))).alias("published_at"),
        (ended(is_compare()) | F.coalesce(F.bool_or(kind == "dataset_end"), F.lit(False))).alias("_compare"),
        ended(is_download()).alias("_download"),
        ended(is_extract()).alias("_extract"),
    )
    return runs.withColumn("phase", phase(F.col("_compare"), F.col("_download"), F.col("_extract"))).drop("_compare", "_download", "_extract")


def phase(compare: Column, download: Column, extract: Column) -> Column:
    return F.when(compare, "compare").when(download & extract, "all").when(extract, "extract").when(download, "download").otherwise("unknown")


def key_figures(runs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Ends of the latest good compare and download runs (by start), and the latest published data set.

    state (in_progress, completed_at): where nothing is in progress, its completion counts as a publication.
    """
    if state is not None:
        done = state.where(~F.coalesce("in_progress", F.lit(False))).select(F.col("completed_at").alias("published_at"))
        runs = runs.unionByName(done, allowMissingColumns=True)
    ok = F.col("status") == "ok"
    end = F.coalesce("ended_at", "started_at")
    latest = lambda p: F.max_by(F.when(ok & (F.col("phase") == p), end), F.when(ok & (F.col("phase") == p) & end.isNotNull(), F.struct(F.coalesce("started_at", F.lit(0).cast("timestamp").cast(dict(runs.dtypes)["started_at"])), "run_id")))
    return runs.agg(latest("compare").alias("last_compare_ok_at"), latest("download").alias("last_download_ok_at"), F.max("published_at").alias("last_published_at"))


def runs_by_day(runs: DataFrame) -> DataFrame:
    day = local_day(F.coalesce("started_at", "ended_at"))
    return runs.withColumn("day", day).where("day is not null")


def split_by_timeline(runs: DataFrame, center: Column, days: int = 10) -> DataFrame:
    """Adds in_window: whether the run's day is within the timeline about the centre."""
    day = local_day(F.coalesce("started_at", "ended_at"))
    return runs.withColumn("in_window", F.coalesce(day.between(F.date_sub(center, days), F.date_add(center, days)), F.lit(False)))


def upsert_snapshots(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Snapshots with those of equal ``by`` replaced; idempotent."""
    return old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def with_previous(snapshots: DataFrame, by: list[str], order: str, metrics: list[str]) -> DataFrame:
    """Adds prev_m for each metric: its value in the run before."""
    w = Window.partitionBy(*by).orderBy(order)
    return snapshots.withColumns({f"prev_{m}": F.lag(m).over(w) for m in metrics})


def download_outcome(status: Column, used_cache: Column, reason: Column) -> Column:
    return (
        F.when(status == "fail", "failed")
        .when((status == "skipped") & reason.eqNullSafe(F.lit("fallback_osm_cache_restored")), "fallback_artifact")
        .when((status == "ok") & used_cache, "cache_window").when(status == "ok", "fresh")
        .when((status == "skipped") & used_cache, "cache_window").otherwise("failed")
    )


def fallback_streaks(attempts: DataFrame, by: list[str], order: str, limit: int = 2) -> DataFrame:
    """Adds streak and ok: fallbacks since the last good outcome; a failure leaves the streak as it was and is never ok.

    attempts: by.., order, outcome in fresh, cache_window, fallback_artifact, failed.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("outcome").isin("fresh", "cache_window")
    islands = attempts.withColumn("_island", F.sum(good.cast("long")).over(w))
    inside = Window.partitionBy(*by, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum((F.col("outcome") == "fallback_artifact").cast("long")).over(inside)
    return islands.withColumn("streak", streak).withColumn("ok", good | ((F.col("outcome") == "fallback_artifact") & (F.col("streak") <= limit))).drop("_island")
