"""Keyed state over streams: events of a run so far, fallback streaks; progress written as events."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_so_far(events: DataFrame, key: str) -> DataFrame:
    """All events so far of every key that a batch touches, with the columns of ``events``.

    The events of a key are its state, so a batch reads what its own keys have and nothing else of the log.
    """

    def grow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held += [x for frame in frames for x in frame["_event"]]
        state.update((held,))
        yield pd.DataFrame({"_event": held})

    packed = events.select(key, F.to_json(F.struct(*events.columns)).alias("_event"))
    grown = packed.groupBy(key).applyInPandasWithState(grow, "_event string", "events array<string>", "update", GroupStateTimeout.NoTimeout)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return grown.select(F.from_json("_event", schema).alias("e")).select("e.*")


def streamed_streaks(attempts: DataFrame, key: str, order: str, limit: int = 2) -> DataFrame:
    """(key, order, outcome, streak, ok, late): ``fallback_streaks`` over a stream of attempts (key string, order long, outcome).

    Attempts of one batch may come in any order; one that is older than its key's last batch counts no more: it has no
    streak and is late. Equal attempts are counted each.
    """

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak = state.get if state.exists else (None, 0)
        batch = pd.concat(list(frames)).sort_values([order, "outcome"], kind="stable")
        rows = []
        for at, outcome in zip(batch[order].tolist(), batch["outcome"].tolist(), strict=True):
            if last is not None and at < last:
                rows.append((group[0], at, outcome, None, None, True))
                continue
            good = outcome in ("fresh", "cache_window")
            streak = 0 if good else streak + (outcome == "fallback_artifact")
            rows.append((group[0], at, outcome, streak, good or (outcome == "fallback_artifact" and streak <= limit), False))
        state.update((max([int(batch[order].iloc[-1]), *([] if last is None else [last])]), streak))
        out = pd.DataFrame(rows, columns=[key, order, "outcome", "streak", "ok", "late"])
        yield out.astype({"streak": "Int64", "ok": "boolean"})

    schema = f"{key} string, {order} bigint, outcome string, streak bigint, ok boolean, late boolean"
    return attempts.select(key, order, "outcome").groupBy(key).applyInPandasWithState(follow, schema, "last bigint, streak bigint", "update", GroupStateTimeout.NoTimeout)


class ProgressLog(StreamingQueryListener):
    """Writes what queries do as log events, one JSON line each: run_start, heartbeat (rows and observed metrics of a batch), run_end.

    An idle query says so too. The file is the driver's; give each driver its own.
    """

    def __init__(self, path: str):
        self.path = Path(path)

    def say(self, kind: str, query, **more) -> None:
        with self.path.open("a") as out:
            out.write(json.dumps({"kind": kind, "run_id": str(query.runId), **more}) + "\n")

    def onQueryStarted(self, event) -> None:
        self.say("run_start", event, at=event.timestamp, name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        self.say("heartbeat", p, at=p.timestamp, batch=p.batchId, rows=p.numInputRows, duration_ms=p.durationMs.get("triggerExecution", 0), observed=seen)

    def onQueryIdle(self, event) -> None:
        self.say("heartbeat", event, at=event.timestamp, rows=0)

    def onQueryTerminated(self, event) -> None:
        self.say("run_end", event, status="fail" if event.exception else "ok")
