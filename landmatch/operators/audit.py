"""Checks of what a run leaves behind: whose files they are, how large, and whether their content changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a report must not carry, and what an area's source folder may hold.
FORBIDDEN_ENDS = (".pbf", ".zip", ".gpkg")
SOURCE_FILES = ("official.fgb", "metadata.json")


def violation(owner: Column, path: Column, shared_files: list[str]) -> Column:
    """Whether a file has no place under its owner: report-runtime, source-cache-osm or source-cache-official."""
    lower, parts = F.lower(path), F.split(path, "/")
    report = path.contains("/source/") | lower.rlike("|".join(f"\\{e}$" for e in FORBIDDEN_ENDS))
    shared = ~path.isin(shared_files)
    fits = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "datasets") & (F.get(parts, F.lit(2)) == "source") & F.get(parts, F.lit(3)).isin(*SOURCE_FILES)
    official = ~F.coalesce(fits, F.lit(False))
    return F.when(owner == "report-runtime", report).when(owner == "source-cache-osm", shared).when(owner == "source-cache-official", official).otherwise(F.lit(False))


def shared_paths(files: DataFrame) -> DataFrame:
    """(path, owners): files (owner, path) that more than one owner has."""
    return files.groupBy("path").agg(F.count("*").alias("_n"), F.array_sort(F.collect_set("owner")).alias("owners")).where("_n > 1").select("path", "owners")


def inventory(files: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """(by.., files, bytes, forbidden, largest): counts, and the paths of the largest files, by size and then path."""
    ends = F.lower("path").rlike("|".join(f"\\{e}$" for e in FORBIDDEN_ENDS))
    rank = F.struct((-F.col("bytes")).alias("b"), F.col("path").alias("path"))
    # a group's best few are found in shares of it first, so that no list holds the whole group
    shares = files.groupBy(*by, F.pmod(F.xxhash64("path"), F.lit(64)).alias("_share")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(ends).alias("forbidden"), F.slice(F.array_sort(F.collect_list(rank)), 1, top).alias("best"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top)
    return shares.groupBy(*by).agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.sum("forbidden").alias("forbidden"), F.transform(best, lambda x: x["path"]).alias("largest"))


def fingerprint(files: DataFrame, by: list[str]) -> DataFrame:
    """(by.., fingerprint): SHA-256 over each group's paths and contents in path order, each followed by a zero byte.

    A digest needs its bytes in order, so a group is one task's; its files come sorted from Spark's external sort and
    feed the digest one by one, so that no more than a batch of them is in memory. Null contents are empty.
    """
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    rows = files.select(group.alias("_group"), F.col("path").cast("binary").alias("_path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("_content"))
    ordered = rows.repartition("_group").sortWithinPartitions("_group", "_path", "_content")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda g, d: pa.record_batch([pa.array([g]), pa.array([d.hexdigest()])], names=["_group", "fingerprint"])
        now, digest = None, None
        for batch in batches:
            for g, path, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                if digest is None or g.as_py() != now:
                    if digest is not None:
                        yield told(now, digest)
                    now, digest = g.as_py(), hashlib.sha256()
                digest.update(path.as_py() or b"")
                digest.update(b"\0")
                digest.update(content.as_py())
                digest.update(b"\0")
        if digest is not None:
            yield told(now, digest)

    found = ordered.mapInArrow(digests, "_group string, fingerprint string")
    parsed = F.from_json("_group", ", ".join(f"`{c}` {kinds[c]}" for c in by))
    return found.select(parsed.alias("_g"), "fingerprint").select(*[F.col(f"_g.{c}").alias(c) for c in by], "fingerprint")


def grouped_sources(configs: DataFrame) -> DataFrame:
    """(url, areas): the areas (area, url) that fetch an address, sorted."""
    return configs.where("url is not null").groupBy("url").agg(F.array_sort(F.collect_set("area")).alias("areas"))
