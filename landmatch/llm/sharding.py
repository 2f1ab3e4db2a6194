"""Resharding by minimum-cost flow.

Old shard sizes are the supplies, new capacities the demands, and a byte that changes its shard costs 1.
The solution, at most old + new - 1 block transfers beside what stays, is turned into byte intervals of
every old shard: a row goes where its middle byte lies in its shard's running total. Running totals
come from two passes: each partition numbers its own rows, and one row per (partition, old shard)
is summed to make the places global. Neither texts nor rows are shuffled.

Rows of over 1/LARGE of a shard come first in their shard, the largest before the others, so that
the cuts fall between small rows and sizes come out near equal.

Defined cases: a null text has only the overhead of its row; repeated rows are placed one by one; an
empty table gives an empty result; a row without an old shard (null) counts as of shard 0; the output has its own
columns alone, so that columns of the input may have their names.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landmatch.llm.common import shared_folder

OVERHEAD = 16
LARGE = 64


def transfers(sizes: list[int], capacities: list[int], cost=lambda i, j: int(i != j)) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of least total cost: successive shortest paths with potentials.

    The capacities must sum to the sizes at least. The graph has one node per shard on either
    side; its size depends on the shard counts alone.
    """
    if sum(capacities) < sum(sizes):
        raise ValueError("the new shards are too small")
    olds, news = len(sizes), len(capacities)
    left, room = list(sizes), list(capacities)
    flow: dict[tuple[int, int], int] = {}
    high = [0] * (olds + news)
    while any(left):
        far = [float("inf")] * (olds + news)
        via: list[int | None] = [None] * (olds + news)
        queue = []
        for i in range(olds):
            if left[i]:
                far[i] = 0
                queue.append((0, i))
        heapq.heapify(queue)
        done = [False] * (olds + news)
        while queue:
            d, x = heapq.heappop(queue)
            if done[x]:
                continue
            done[x] = True
            if x < olds:
                steps = ((olds + j, cost(x, j)) for j in range(news))
            else:
                steps = ((i, -cost(i, x - olds)) for i in range(olds) if flow.get((i, x - olds)))
            for y, c in steps:
                e = d + c + high[x] - high[y]
                if e < far[y]:
                    far[y], via[y] = e, x
                    heapq.heappush(queue, (e, y))
        end = min((olds + j for j in range(news) if room[j]), key=lambda y: (far[y] + high[y], y))
        for x in range(olds + news):
            high[x] += min(far[x], far[end])
        path, x = [], end
        while via[x] is not None:
            path.append((via[x], x))
            x = via[x]
        most = min([left[x], room[end - olds], *(flow[y, a - olds] for a, y in path if a >= olds)])
        for a, y in path:
            if a < olds:
                flow[a, y - olds] = flow.get((a, y - olds), 0) + most
            else:
                flow[y, a - olds] -= most
        left[x] -= most
        room[end - olds] -= most
    return sorted((i, j, n) for (i, j), n in flow.items() if n)


def intervals(plan: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(old, low, high, new): what stays comes first, then the transfers by falling size."""
    out, at = [], {}
    for i, j, n in sorted(plan, key=lambda t: (t[0], t[0] != t[1], -t[2], t[1])):
        low = at.get(i, 0)
        out.append((i, low, low + n, j))
        at[i] = low + n
    return out


def reshard(docs: DataFrame, old_shard: Column, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, old_shard, shard, slot) of every row; sizes of the shards are near equal."""
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(content) + OVERHEAD).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
    )
    first = rows.agg(F.sum("size"), F.max("old_shard")).first()
    total, olds = int(first[0] or 0), int(first[1] or 0) + 1
    limit = max(1, total // shards // LARGE)
    rank = F.when(F.col("size") > limit, F.floor(F.log2("size")).cast("int")).otherwise(F.lit(0))
    kind = dict(rows.dtypes)[key]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's place and the bytes before it among the rows of its rank and old shard in this partition."""
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            size = batch.column("size").to_numpy()
            run = batch.column("old_shard").to_numpy().astype(np.int64) * 64 + batch.column("large").to_numpy()
            order = np.argsort(run, kind="stable")
            place, before = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            names, starts, counts = np.unique(run[order], return_index=True, return_counts=True)
            for name, start, n in zip(names.tolist(), starts.tolist(), counts.tolist(), strict=True):
                at = order[start : start + n]
                rows_before, bytes_before = seen.get(name, (0, 0))
                sums = np.cumsum(size[at])
                place[at] = rows_before + np.arange(n)
                before[at] = bytes_before + sums - size[at]
                seen[name] = rows_before + n, bytes_before + int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int64)), pa.array(place), pa.array(before)], [key, "size", "text_crc32", "old_shard", "large", "part", "place", "before"])

    at = f"{shared_folder(spark)}/sizes-{uuid.uuid4().hex}"
    numbered = rows.withColumn("large", rank).mapInArrow(number, f"`{key}` {kind}, size long, text_crc32 long, old_shard int, large int, part long, place long, before long")
    numbered.write.parquet(at)
    held = spark.read.parquet(at)

    runs = held.groupBy("old_shard", "large", "part").agg(F.sum("size").alias("bytes"))
    ahead = Window.partitionBy("old_shard").orderBy(F.desc("large"), "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("old_shard", "large", "part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"))
    sizes = dict(runs.groupBy("old_shard").agg(F.sum("bytes")).collect())
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    plan = transfers([sizes.get(i, 0) for i in range(olds)], capacities)
    cuts = intervals(plan)
    table = spark.createDataFrame(cuts or [(0, 0, 0, 0)], "old_shard int, low long, high long, shard int")

    placed = (
        held.join(bases, ["old_shard", "large", "part"])
        .withColumn("middle", F.col("base") + F.col("before") + F.floor(F.col("size") / 2))
        # at most old + new shards rows
        .join(F.broadcast(table), [F.col("middle") >= table.low, F.col("middle") < table.high, held.old_shard == table.old_shard])
        .drop(table.old_shard)
    )
    # rows of one run that share a shard are consecutive, so a run needs one row per shard
    spans = placed.groupBy("shard", "old_shard", "large", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    above = Window.partitionBy("shard").orderBy("old_shard", F.desc("large"), "part").rowsBetween(Window.unboundedPreceding, -1)
    seats = spans.select("shard", "old_shard", "large", "part", (F.coalesce(F.sum("n").over(above), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(seats, ["shard", "old_shard", "large", "part"]).select(key, "size", "text_crc32", "old_shard", "shard", (F.col("place") + F.col("shift")).alias("slot"))


def rewrite(spark: SparkSession, folder: str, assigned: DataFrame, key: str = "doc_id", column: str = "shard") -> list[int]:
    """Rewrites the shards (folder/shard=N) that lose or gain rows; the others keep their files. Returns the rewritten shards.

    assigned: (key, old_shard, shard) of every row of the folder. Rows that share a key and a shard are told apart by
    numbers on both sides: each is moved once, whichever of the targets it gets. A stored row without a target, or a
    target without a row, raises before any file is touched. New files are written beside the old
    ones; once they are complete, each old shard is set aside before the new one takes its place, and what was set
    aside goes last. A rename that fails takes back those before it and raises: no state lacks a row.
    """
    stored = spark.read.parquet(folder)
    moves = assigned.select(F.col(key), F.col("old_shard"), F.col("shard").alias("_to"))
    touched = sorted({s for row in moves.where("old_shard <> _to").select("old_shard", "_to").distinct().collect() for s in row})  # at most a row per pair of shards
    if not touched:
        return []
    run = uuid.uuid4().hex
    staged, aside = (f"{folder.rstrip('/')}-{kind}-{run}" for kind in ("staged", "replaced"))
    copies = lambda shard, order: F.row_number().over(Window.partitionBy(key, shard).orderBy(order))
    held = stored.where(F.col(column).isin(touched)).withColumn("_copy", copies(column, F.xxhash64(*stored.columns)))
    meant = moves.where(F.col("old_shard").isin(touched)).select(F.col(key).alias("_key"), F.col("old_shard").alias("_from"), "_to", copies("old_shard", "_to").alias("_nth"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(column) == F.col("_from")) & (F.col("_copy") == F.col("_nth"))
    lost = held.join(meant, same, "full").where(F.col("_from").isNull() | F.col("_copy").isNull()).select(F.coalesce(F.col(key), F.col("_key")).alias("key")).limit(1).collect()
    if lost:
        raise ValueError(f"the plan and the stored shards differ in the rows of key {lost[0]['key']!r}")
    changed = held.join(meant, same)
    changed.select(*[c for c in stored.columns if c != column], F.col("_to").alias(column)).write.partitionBy(column).parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda root, shard: path(f"{root}/{column}={shard}")
    files.mkdirs(path(aside))
    done: list[tuple] = []  # renames made, as (from, to)
    try:
        for shard in touched:
            for a, b in ((at(folder, shard), at(aside, shard)), (at(staged, shard), at(folder, shard))):
                if files.exists(a):
                    renamed(files, a, b)
                    done.append((a, b))
    except Exception:
        for a, b in reversed(done):  # the old shards come back; the new files stay staged
            renamed(files, b, a)
        raise
    files.delete(path(aside), True)
    files.delete(path(staged), True)
    return touched


def renamed(files, a, b) -> None:
    if not files.rename(a, b):
        raise OSError(f"{a} could not be renamed to {b}")
