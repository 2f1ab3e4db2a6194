"""Run-status and attempt documents, folded from their updates.

An update is a row; a folder's document is what all its updates in order leave behind. The last update of every
branch is found by aggregates that combine before the shuffle, so a folder of any number of updates costs one small
row per task and branch; a document itself has a branch per step and area. A stored document is read back as
updates (``as_updates``), so writing over one is the same fold over its rows and the new ones.

Updates: by, seq (long, the order; new ones above 0), at (ISO instant), op, name (step or area), run_id, started_at, status, branch.
op is start, shared, compare, official, end or touch. A start empties the document; an end keeps its
branches; a branch is replaced as a whole. Updates without a start or an end before them are those of an unknown run.

Defined cases: a null name is the empty name; of equal seq the larger row counts; a malformed stored document,
one of another version or without a run counts as none; no updates give no document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRANCH = "status string, updatedAt string, usedCache boolean, sourceOrigin string, artifactTimestamp string, errorCode string, errorMessage string, retryHint string, compareOutputOrigin string, compareOutputGeneratedAt string"
AREA = f"compare struct<{BRANCH}>, officialDownload struct<{BRANCH}>"
DOCUMENT = f"version int, runId string, startedAt string, updatedAt string, inProgress boolean, status string, shared map<string,struct<{BRANCH}>>, areas map<string,struct<{AREA}>>"
VERSION = 1
#: Fallbacks in a row that are still accepted.
MAX_FALLBACKS = 2


def parsed(document: Column) -> Column:
    """The document as a struct; null if it is none of this version."""
    read = F.from_json(document, DOCUMENT)
    return F.when((read["version"] == VERSION) & read["runId"].isNotNull(), read)


def branch(status: Column, **fields: Column) -> Column:
    """A branch's struct with the named fields; the others are null."""
    types = dict(x.split(" ") for x in BRANCH.split(", "))
    given = {"status": status, **fields}
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in types.items()])


def as_updates(stored: DataFrame, by: str, document: str = "document") -> DataFrame:
    """The updates that leave a stored document behind, all before any new one."""
    docs = stored.select(by, parsed(F.col(document)).alias("d")).where("d is not null")
    empty = F.lit(None).cast(f"struct<{BRANCH}>")

    def row(seq: int, at: Column, op: str, name: Column | None = None, one: Column = empty) -> Column:
        return F.struct(
            F.lit(seq).cast("long").alias("seq"), at.alias("at"), F.lit(op).alias("op"), (F.lit(None).cast("string") if name is None else name).alias("name"),
            F.col("d.runId").alias("run_id"), F.col("d.startedAt").alias("started_at"), F.col("d.status").alias("status"), one.alias("branch"),
        )

    entries = lambda m: F.coalesce(F.map_entries(m), F.array())

    def of_areas(op: str, field: str) -> Column:
        held = F.filter(entries("d.areas"), lambda e: e["value"][field].isNotNull())
        return F.transform(held, lambda e: row(-1, e["value"][field]["updatedAt"], op, e["key"], e["value"][field]))

    shared = F.transform(entries("d.shared"), lambda e: row(-1, e["value"]["updatedAt"], "shared", e["key"], e["value"]))
    ends = F.when(~F.coalesce("d.inProgress", F.lit(False)), F.array(row(-1, F.col("d.updatedAt"), "end"))).otherwise(F.array())
    rows = F.concat(F.array(row(-2, F.col("d.startedAt"), "start"), row(0, F.col("d.updatedAt"), "touch")), ends, shared, of_areas("compare", "compare"), of_areas("official", "officialDownload"))
    return docs.select(by, F.explode(rows).alias("u")).select(by, "u.*")


def documents(updates: DataFrame, by: str) -> DataFrame:
    """(by, document): one JSON document per folder."""
    said = F.struct("seq", "at", "run_id", "started_at", "status", F.col("branch").alias("branch"))
    op, last = F.col("op"), lambda *ops: F.max(F.when(op.isin(*ops), said))
    scope = F.when(op.isin("compare", "official"), "area").when(op == "shared", "shared").otherwise("run")
    named = updates.withColumn("_scope", scope).withColumn("name", F.when(scope == "run", "").otherwise(F.coalesce("name", F.lit(""))))
    when = F.struct("seq", "at")
    per = named.groupBy(by, "_scope", "name").agg(last("start").alias("_start"), last("end").alias("_end"), last("shared", "compare").alias("_one"), last("official").alias("_two"), F.min(when).alias("_first"), F.max(when).alias("_last"))
    is_run = F.col("_scope") == "run"
    whole = per.groupBy(by).agg(
        F.max("_start").alias("start"), F.max("_end").alias("end"), F.max("_last").alias("last"), F.min(F.when(~is_run, F.col("_first"))).alias("first"),
        F.collect_list(F.when(~is_run, F.struct("_scope", "name", "_one", "_two"))).alias("all"),
    )
    # what stands before the last start is gone
    live = lambda x: F.when(F.col("start").isNull() | (x["seq"] > F.col("start.seq")), x)
    dated = lambda x: F.when(live(x).isNotNull(), x["branch"].withField("updatedAt", x["at"]))
    kept = F.sort_array(F.filter("all", lambda e: live(e["_one"]).isNotNull() | live(e["_two"]).isNotNull()))
    of = lambda scope, value: F.map_from_entries(F.transform(F.filter(kept, lambda e: e["_scope"] == scope), lambda e: F.struct(e["name"], value(e))))
    ended = live(F.col("end"))
    unknown = F.concat(F.lit("unknown-"), F.unix_millis(F.to_timestamp("first.at")).cast("string"))
    document = F.struct(
        F.lit(VERSION).alias("version"), F.coalesce(ended["run_id"], F.col("start.run_id"), unknown).alias("runId"), F.coalesce(ended["started_at"], F.col("start.started_at"), F.col("first.at")).alias("startedAt"),
        F.col("last.at").alias("updatedAt"), ended.isNull().alias("inProgress"), ended["status"].alias("status"), of("shared", lambda e: dated(e["_one"])).alias("shared"),
        of("area", lambda e: F.struct(dated(e["_one"]).alias("compare"), dated(e["_two"]).alias("officialDownload"))).alias("areas"),
    )
    return whole.select(by, F.to_json(document).alias("document"))


def rewritten(stored: DataFrame, updates: DataFrame, by: str) -> DataFrame:
    """(by, document): stored documents with the updates written over them; folders of either side stay, but for malformed documents without updates."""
    return documents(as_updates(stored, by).unionByName(updates), by)


def attempts(rows: DataFrame, by: str) -> DataFrame:
    """(by, run_id, fresh, fallback): the last attempt of either kind of a folder's last run.

    rows: by, seq, run_id, attempt, outcome, error_message. An attempt of another run empties the document, so those
    before it do not count, though a run comes back.
    """
    said = F.struct("seq", "outcome", "error_message")
    fresh = F.col("attempt").eqNullSafe(F.lit("fresh"))
    per = rows.groupBy(by, "run_id").agg(F.max("seq").alias("_seq"), F.max(F.when(fresh, said)).alias("fresh"), F.max(F.when(~fresh, said)).alias("fallback"))
    # two runs of a folder tell: the last one, and the end of the one before it
    ranked = per.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_seq"), F.desc("run_id")))).where("_rank <= 2")
    runs = ranked.groupBy(by).agg(F.max(F.when(F.col("_rank") == 2, F.col("_seq"))).alias("_before"), F.max(F.when(F.col("_rank") == 1, F.struct("_seq", "run_id", "fresh", "fallback"))).alias("_last"))
    before = F.col("_before")
    valid = lambda c: F.when(before.isNull() | (F.col(f"_last.{c}.seq") > before), F.struct(F.col(f"_last.{c}.outcome").alias("outcome"), F.col(f"_last.{c}.error_message").alias("error_message")))
    there = lambda c: F.when(F.col(f"_last.{c}").isNotNull(), valid(c)).alias(c)
    return runs.select(by, "_last.run_id", there("fresh"), there("fallback"))


def policy(previous: Column, fresh: Column, fallback: Column, limit: int = MAX_FALLBACKS) -> Column:
    """(ok, outcome, streak, error_message) of a run's two attempts, each (outcome, error_message) or null, after ``previous`` fallbacks in a row."""
    before = F.coalesce(previous, F.lit(0)).cast("long")
    good = lambda a: F.coalesce(a["outcome"].isin("fresh", "cache_window"), F.lit(False))
    held = F.coalesce(fallback["outcome"] == "fallback_artifact", F.lit(False))
    over = before + 1 > limit
    # The messages a report shows
    worn = F.concat(F.lit("OSM fallback cache used "), (before + 1).cast("string"), F.lit(f" consecutive runs (limit {limit})"))
    lost = F.lit("OSM PBF download failed on fresh and fallback attempts")
    answer = lambda ok, outcome, streak, message: F.struct(ok.alias("ok"), outcome.alias("outcome"), streak.alias("streak"), message.cast("string").alias("error_message"))
    passed = lambda a: answer(F.lit(True), a["outcome"], F.lit(0).cast("long"), F.lit(None))
    return (
        F.when(good(fresh), passed(fresh)).when(good(fallback), passed(fallback))
        .when(held, answer(~over, F.lit("fallback_artifact"), before + 1, F.when(over, F.coalesce(fresh["error_message"], fallback["error_message"], worn)).otherwise(fresh["error_message"])))
        .otherwise(answer(F.lit(False), F.lit("failed"), before, F.coalesce(fallback["error_message"], fresh["error_message"], lost)))
    )
