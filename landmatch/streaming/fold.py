"""The run log folded as a stream: the batch fold, applied per micro-batch to the runs that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from landmatch.operators.history import fold_runs, upsert_snapshots
from landmatch.streaming.state import events_so_far

LOG = "kind string, run_id string, at timestamp_ntz, seq bigint, step string, dataset string, status string, duration_ms bigint"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that appear in a folder, as a stream."""
    return spark.readStream.schema(LOG).json(folder)


def fold_stream(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table of folded runs up to date; a replayed batch changes nothing.

    Only the runs of the batch are folded anew, from all of their events so far, which are the runs' state: no batch
    reads the log again. Each batch's result is a folder of its own below the table, named by the batch, so that a
    batch which is run again overwrites only itself.
    """

    def fold(touched: DataFrame, number: int) -> None:
        fold_runs(touched).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return events_so_far(events, "run_id").writeStream.outputMode("update").foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_runs(spark: SparkSession, table: str) -> DataFrame:
    """Each run as of the last batch that touched it."""
    stored = spark.read.parquet(table)
    last = stored.groupBy("run_id").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return stored.join(last, ["run_id", "batch"], "left_semi").drop("batch")


def replace_snapshots(old: DataFrame, batch: DataFrame) -> DataFrame:
    """A day's snapshot replaced by that of a later run of the day."""
    return upsert_snapshots(old, batch, ["area", "run_id"])
