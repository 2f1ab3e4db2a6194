"""The registry of discussions: issues by the path they are about, refreshed as a whole or kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.functions.keys import path_match

ISSUE = "number long, title string, html_url string, state string, updated_at string, pull_request struct<url: string>"
ROW = "match string, number long, url string, state string, last_touched_at string"


def read_issue_pages(spark: SparkSession, path: str) -> DataFrame:
    """Issues of stored answers, one JSON list per file; an answer that is none, such as an error's, raises when it is read."""
    return spark.read.schema(ISSUE).option("mode", "FAILFAST").option("multiLine", True).json(path)


def registry(issues: DataFrame) -> DataFrame:
    """(match, number, url, state, last_touched_at) of the issues that are no pull requests.

    Each state but ``open`` is ``closed``. A row without a path, a positive number, an absolute address or a date is an
    error when it is read, as the registry is replaced as a whole; the message names its number.
    """
    plain = issues.where("pull_request is null").select(
        path_match(F.col("title")).alias("match"), "number", F.col("html_url").alias("url"),
        F.when(F.col("state") == "open", "open").otherwise("closed").alias("state"), F.col("updated_at").alias("last_touched_at"),
    )
    fit = (F.col("match") != "") & (F.col("number") > 0) & F.try_parse_url("url", F.lit("HOST")).isNotNull() & (F.col("last_touched_at") != "")
    wrong = F.raise_error(F.concat(F.lit("issue "), F.coalesce(F.col("number").cast("string"), F.lit("without a number")), F.lit(" does not fit the registry")))
    return plain.withColumn("match", F.when(F.coalesce(fit, F.lit(False)), F.col("match")).otherwise(wrong))


def issues_of(rows: DataFrame, asked: DataFrame, path: str) -> DataFrame:
    """asked with each registry row of its path (null where there is none), however either is written."""
    known = rows.withColumn("_at", path_match(F.col("match")))
    return asked.withColumn("_at", path_match(F.col(path))).join(known, "_at", "left").drop("_at")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sync(spark: SparkSession, fetched: DataFrame | None, out: str, checked_at: str) -> bool:
    """Writes ``out/issues`` by number and ``out/checked``; True if the registry is the fetched one.

    Without fetched issues the stored registry stays, an empty one is written where there is none, and ``checked`` goes,
    as nobody knows whether the registry is up to date. Rows are written beside the old ones first, so rows that do not
    fit leave the old registry as it is.
    """
    issues, checked, beside = f"{out}/issues", f"{out}/checked", f"{out}/issues-new"
    if fetched is None:
        _remove(spark, checked)
        if not _exists(spark, issues):
            spark.createDataFrame([], ROW).write.json(issues)
        return False
    registry(fetched).orderBy("number").write.mode("overwrite").json(beside)
    _remove(spark, checked)
    spark.read.schema(ROW).json(beside).orderBy("number").write.mode("overwrite").json(issues)
    _remove(spark, beside)
    spark.createDataFrame([(checked_at,)], "registry_checked_at string").coalesce(1).write.mode("overwrite").json(checked)
    return True
