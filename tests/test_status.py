"""Run-status documents and the decision over attempts, against plain Python."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from landmatch.operators import status

SCHEMA = f"place string, seq long, at string, op string, name string, run_id string, started_at string, status string, branch struct<{status.BRANCH}>"
BLANK = {name.split(" ")[0]: None for name in status.BRANCH.split(", ")}


def up(place, seq, op, name=None, run=None, said=None, **fields):
    at = f"2024-05-01T00:00:{seq:02d}.000Z"
    return place, seq, at, op, name, run, at, said, {**BLANK, "status": said, **fields} if op in ("shared", "compare", "official") else None


def told(rows):
    return {r.place: json.loads(r.document) for r in rows.collect()}


ROWS = [
    up("a", 1, "start", run="r1"), up("a", 2, "shared", "osm", said="success", usedCache=True), up("a", 3, "compare", "berlin", said="success", compareOutputOrigin="current_run"),
    up("a", 4, "official", "berlin", said="failed_no_cache", errorCode="E"), up("a", 5, "compare", "berlin", said="compare_failed"), up("a", 6, "end", run="r1", said="fail"),
    up("b", 1, "start", run="r1"), up("b", 2, "shared", "osm", said="success"), up("b", 3, "end", run="r1", said="ok"), up("b", 4, "start", run="r2"), up("b", 5, "official", "bonn", said="skipped"),
    up("c", 7, "shared", None, said="success"), up("c", 8, "compare", "x", said="skipped"),
    up("d", 1, "end", run="r9", said="ok"), up("d", 2, "compare", "x", said="success"),
]


def check(docs):
    a, b, c, d = (docs[k] for k in "abcd")
    assert (a["version"], a["runId"], a["inProgress"], a["status"], a["updatedAt"]) == (1, "r1", False, "fail", "2024-05-01T00:00:06.000Z")
    assert a["shared"]["osm"] == {"status": "success", "updatedAt": "2024-05-01T00:00:02.000Z", "usedCache": True}
    # a branch is replaced as a whole, its sibling stays
    assert a["areas"]["berlin"]["compare"] == {"status": "compare_failed", "updatedAt": "2024-05-01T00:00:05.000Z"}
    assert a["areas"]["berlin"]["officialDownload"]["errorCode"] == "E"
    # a start empties
    assert (b["runId"], b["inProgress"], b["shared"], list(b["areas"])) == ("r2", True, {}, ["bonn"]) and "status" not in b and "compare" not in b["areas"]["bonn"]
    # no start: an unknown run, dated by its first update
    assert (c["runId"], c["startedAt"], list(c["shared"]), list(c["areas"])) == ("unknown-1714521607000", "2024-05-01T00:00:07.000Z", [""], ["x"])
    # after an end, branches still change
    assert (d["runId"], d["status"], d["inProgress"], d["updatedAt"], list(d["areas"])) == ("r9", "ok", False, "2024-05-01T00:00:02.000Z", ["x"])


def test_documents(spark):
    check(told(status.documents(spark.createDataFrame(ROWS, SCHEMA), "place")))
    assert status.documents(spark.createDataFrame([], SCHEMA), "place").count() == 0


@pytest.mark.parametrize("cut", range(9))
def test_written_over_at_any_point(spark, cut):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    stored = status.documents(rows.where(F.col("seq") <= cut), "place")
    check(told(status.rewritten(stored, rows.where(F.col("seq") > cut), "place")))


def test_malformed_documents_count_as_none(spark):
    bad = [("a", "{broken"), ("b", '{"version":2,"runId":"x"}'), ("c", '{"version":1}'), ("d", None), ("e", "[]")]
    stored = spark.createDataFrame(bad, "place string, document string")
    assert told(status.rewritten(stored, spark.createDataFrame([], SCHEMA), "place")) == {}
    check(told(status.rewritten(stored, spark.createDataFrame(ROWS, SCHEMA), "place")))


def plain_policy(previous, fresh, fallback):
    good = ("fresh", "cache_window")
    for x in (fresh, fallback):
        if x and x[0] in good:
            return True, x[0], 0, None
    message = lambda *xs: next((x[1] for x in xs if x and x[1]), None)
    if fallback and fallback[0] == "fallback_artifact":
        if previous + 1 > 2:
            return False, "fallback_artifact", previous + 1, message(fresh, fallback) or f"OSM fallback cache used {previous + 1} consecutive runs (limit 2)"
        return True, "fallback_artifact", previous + 1, message(fresh)
    return False, "failed", previous, message(fallback, fresh) or "OSM PBF download failed on fresh and fallback attempts"


def test_policy_of_all_pairs(spark):
    said = [None, *((o, m) for o in ("fresh", "cache_window", "fallback_artifact", "failed") for m in (None, "broken"))]
    cases = [(p, f, b) for p in (0, 1, 2, 3) for f in said for b in said]
    attempt = "struct<outcome:string,error_message:string>"
    rows = spark.createDataFrame(cases, f"p int, f {attempt}, b {attempt}").select("p", "f", "b", status.policy(F.col("p"), F.col("f"), F.col("b")).alias("x")).collect()
    assert all(tuple(r.x) == plain_policy(r.p, r.f and tuple(r.f), r.b and tuple(r.b)) for r in rows) and len(rows) == len(cases)


def test_attempts_of_a_run_that_comes_back(spark):
    rows = [("a", 1, "r1", "fresh", "failed", "e1"), ("a", 2, "r2", "fresh", "fresh", None), ("a", 3, "r1", "fallback", "fallback_artifact", None), ("b", 1, "r1", "fresh", "failed", "e1"), ("b", 2, "r1", "fallback", "failed", "e2"), ("b", 3, "r1", "fresh", "fresh", None)]
    got = {r.place: r for r in status.attempts(spark.createDataFrame(rows, "place string, seq long, run_id string, attempt string, outcome string, error_message string"), "place").collect()}
    assert (got["a"].run_id, got["a"].fresh, got["a"].fallback.outcome) == ("r1", None, "fallback_artifact")
    assert (got["b"].fresh.outcome, got["b"].fallback.error_message) == ("fresh", "e2")
