"""Keyed state over streams: restarts, shuffled batches, what a batch reads, and the progress log."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from landmatch.operators import history
from landmatch.streaming import fold, state

OUTCOMES = ("fresh", "cache_window", "fallback_artifact", "failed")


def attempts_of(rng, n):
    return [{"source": f"s{rng.randrange(3)}", "at": k, "outcome": rng.choices(OUTCOMES, [1, 1, 4, 1])[0]} for k in range(n)]


def test_streaks_equal_the_batch_form_after_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = attempts_of(rng, 90)
    (tmp_path / "in").mkdir()
    schema = "source string, at bigint, outcome string"
    for k in range(3):  # each part is a batch of a query of its own, which goes on from the checkpoint
        part = rows[30 * k : 30 * k + 30]
        rng.shuffle(part)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in part))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        out = state.streamed_streaks(stream, "source", "at")
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    wanted = history.fallback_streaks(spark.createDataFrame([(r["source"], r["at"], r["outcome"]) for r in rows], schema), ["source"], "at")
    columns = ["source", "at", "outcome", "streak", "ok"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, wanted.select(columns).collect()))
    assert got.where("late").count() == 0

    # an attempt from before the last batch has no streak and changes none
    (tmp_path / "in" / "9.json").write_text(json.dumps({"source": "s1", "at": 3, "outcome": "fresh"}))
    out = state.streamed_streaks(spark.readStream.schema(schema).json(str(tmp_path / "in")), "source", "at")
    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    late = spark.read.parquet(str(tmp_path / "out")).where("late").collect()
    assert [(r["source"], r["at"], r["streak"], r["ok"]) for r in late] == [("s1", 3, None, None)]


def event(run, k, **more):
    return json.dumps({"kind": "step_end", "run_id": run, "at": f"2024-01-01T00:{k % 60:02d}:00", "seq": k, "step": f"compare:{k}", "status": "ok", "duration_ms": k, **more})


def test_a_batch_reads_its_own_runs_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table, seen, count = str(tmp_path / "table"), [], 0
    for k in range(4):  # every batch has 20 events of new runs and one of run 0
        lines = [event("r0", count)] + [event(f"r{k}.{j}", count + j) for j in range(20)]
        count += len(lines)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        query = fold.fold_stream(fold.read_log(spark, str(tmp_path / "in")), table, str(tmp_path / "ck"))
        query.awaitTermination()
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert seen == [21] * 4  # the log behind is not read again
    folded = spark.read.parquet(table)
    assert [r["n"] for r in folded.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [21] * 4
    now = fold.current_runs(spark, table)
    wanted = history.fold_runs(spark.read.schema(fold.LOG).json(str(tmp_path / "in")))
    assert sorted(map(str, now.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    assert now.where("run_id = 'r0'").first()["n_steps"] == 4


def test_progress_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(event("r", k) for k in range(5)))
    log = state.ProgressLog(str(tmp_path / "log.json"))
    spark.streams.addListener(log)
    try:
        stream = fold.read_log(spark, str(tmp_path / "in")).observe("seen", F.count("*").alias("events"), F.max("seq").alias("last"))
        query = stream.writeStream.format("noop").queryName("folding").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    told = [json.loads(x) for x in (tmp_path / "log.json").read_text().splitlines()]
    assert [t["kind"] for t in told][0] == "run_start"
    assert told[0]["name"] == "folding"
    beat = next(t for t in told if t["kind"] == "heartbeat" and t["rows"])
    assert (beat["rows"], beat["observed"]["seen"]) == (5, {"events": 5, "last": 4})
    assert (told[-1]["kind"], told[-1]["status"]) == ("run_end", "ok")
    assert len({t["run_id"] for t in told}) == 1
