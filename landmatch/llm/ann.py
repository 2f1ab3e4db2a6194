"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by their own k-means codebook, fitted on a bounded sample;
a vector's cell is its pair of centroids, and every vector is indexed. A query takes the cells in the order of
their summed distance until they hold enough vectors, and the vectors of those cells are reranked by exact
Euclidean distance in double precision. How many are enough depends on the data: it is measured, for a fixed
number of queries, against an exact pass over all vectors.

Where a walk ends is one number, the summed distance of its last cell. So a query travels as its vector and that
number, and never as a list of cells, of which it may want most. Vectors and queries meet by block: a run of cells
that holds about BLOCK vectors (less in a small table, for all cores to have some), or a part of one cell that
holds more. A block that more than LOT queries want is met by lots of them. So a task holds a few times BLOCK
vectors and LOT queries, however large the table is and however long the walks are, and each meeting returns its
best k for a query.
Equal vectors are one entry that keeps the k + 1 smallest ids; no result can need more of them,
as ties go to the smaller id.

Defined cases: null vectors, zero vectors and those with null or non-finite components take no
part, nor do those of another length than most; a query with fewer candidates than k gets all of
them; rows that share vector and id count as one; an empty table gives an empty result; the output has its own
columns alone, so that columns of the input may have their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmatch.llm.common import Scratch

#: Rows the codebooks are fitted on, at most (about: a hash of the id keeps an even share).
MAX_SAMPLE = 20_000
MAX_CENTROIDS = 1024
PER_CELL = 1
#: The walk's length is set so that, for this many queries, this share of their exact neighbours is reached.
TRIALS = 64
REACHED = 0.96
BLOCK = 8192
LOT = 8192
#: Points, and queries, whose distances are held at once.
CHUNK, ASKED = 1024, 32
#: Bins in which the end of a walk is looked for.
BINS = 4096


def valid(vector: str) -> Column:
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from distinct starting points; a centroid without points stays."""
    start = np.unique(points, axis=0)
    centers = start[np.random.default_rng(seed).permutation(len(start))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = closest(points, centers)
        n = np.bincount(near, minlength=len(centers))
        for d in range(points.shape[1]):
            sums = np.bincount(near, weights=points[:, d], minlength=len(centers))
            centers[n > 0, d] = sums[n > 0] / n[n > 0]
    return centers


def closest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of each point's nearest center."""
    out, norms = np.empty(len(points), np.int64), (centers**2).sum(1)
    for i in range(0, len(points), CHUNK):
        out[i : i + CHUNK] = (norms - 2 * points[i : i + CHUNK] @ centers.T).argmin(1)
    return out


def cell_scores(query: np.ndarray, books: list[np.ndarray], cells: np.ndarray) -> np.ndarray:
    """Summed squared distance of both halves of a query from those of each cell (c1 * len(books[1]) + c2)."""
    half, width = books[0].shape[1], len(books[1])
    # of each query by itself, so that it is the same number wherever it is needed
    return ((books[0] - query[:half]) ** 2).sum(1)[cells // width] + ((books[1] - query[half:]) ** 2).sum(1)[cells % width]


def reach(scores: np.ndarray, held: np.ndarray, enough: int) -> float:
    """The least score up to which cells hold ``enough`` vectors; infinite if all of them do not hold more."""
    low, high = scores.min(), scores.max()
    if held.sum() <= enough or not np.isfinite(high):
        return math.inf
    bins = ((scores - low) * (BINS / (high - low if high > low else 1.0))).astype(np.int64)
    upto = np.cumsum(np.bincount(bins, weights=held))
    last = int(np.searchsorted(upto, enough))
    some = np.flatnonzero(bins == last)
    some = some[np.argsort(scores[some], kind="stable")]
    before = upto[last - 1] if last else 0
    return float(scores[some[np.searchsorted(before + np.cumsum(held[some]), enough)]])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def enough(indexed: DataFrame, trial: pa.Table, k: int, reached: float, books: list[np.ndarray], cells: np.ndarray, held: np.ndarray) -> int:
    """Vectors a walk must have seen to reach the share ``reached`` of the trial queries' exact neighbours."""
    asked = matrix(trial["v"].combine_chunks()) if trial.num_rows else np.empty((0, 1))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cell = matrix(batch.column("v")), batch.column("cell").to_numpy()
            for r in range(len(asked) if len(x) else 0):
                score = ((x - asked[r]) ** 2).sum(1)
                best = np.argsort(score, kind="stable")[: k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), r)), pa.array(score[best]), pa.array(cell[best])], ["r", "score", "cell"])

    order = Window.partitionBy("r").orderBy("score", "cell")
    near = indexed.select("v", "cell").mapInArrow(exact, "r long, score double, cell long").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    found: dict[int, list[int]] = {}
    for row in near.collect():  # at most TRIALS * (k + 1) rows
        found.setdefault(row["r"], []).append(row["cell"])
    needed = []
    for r, wanted in found.items():
        scores = cell_scores(asked[r], books, cells)
        needed += [int(held[~(scores > scores[at])].sum()) for at in np.searchsorted(cells, np.unique(wanted)).tolist() for _ in range(wanted.count(int(cells[at])))]
    return max(4 * (k + 1), int(np.quantile(needed, reached, method="higher")) if needed else 0)


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, reached: float = REACHED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all other rows."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    # floats travel as they are; all arithmetic is on doubles
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    whole = vectors.where(valid(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lengths = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None or lengths["n"] < 2:
        return spark.createDataFrame([], result)
    dim, total = lengths["n"], lengths["count"]
    usable = whole.where(F.size("v") == dim)
    half = dim // 2
    scratch, cores = Scratch(spark, "multi-index"), spark.sparkContext.defaultParallelism

    share = min(1.0, MAX_SAMPLE / total)
    sample = usable.where((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(share * 1_000_003)) | F.lit(share >= 1)).select("v").toArrow()
    points = matrix(sample["v"].combine_chunks())
    size = max(2, min(MAX_CENTROIDS, round(math.sqrt(total / PER_CELL))))
    books = [kmeans(points[:, :half], size), kmeans(points[:, half:], size)] if len(points) else [np.zeros((1, half)), np.zeros((1, dim - half))]
    width = len(books[1])

    ranked = usable.select("id", "v").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            cell = closest(x[:, :half], books[0]) * width + closest(x[:, half:], books[1]) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["v", "ids", "cell"])

    # kept, as a cell that is found once more need not be the same in its last bit
    indexed = scratch.keep(entries.mapInArrow(assign, f"v {kind}, ids array<long>, cell long"), "indexed")
    # at most len(books[0]) * len(books[1]) rows, whatever the table holds
    counted = indexed.groupBy("cell").count().toArrow()
    order = np.argsort(cells := counted["cell"].to_numpy())
    cells, held = cells[order], counted["count"].to_numpy()[order]
    # a cell begins in the block of its first vector; a large one takes several
    per = max(1, min(BLOCK, math.ceil(held.sum() / (2 * cores))))
    first, parts = (np.cumsum(held) - held) // per, -(-held // per)
    blocks = int((first + parts).max())

    asking = usable.where("q").select("id", "v").distinct()
    trial = asking.orderBy(F.xxhash64("id"), "id").limit(TRIALS).toArrow()
    candidates = enough(indexed, trial, k, reached, books, cells, held)
    sent = spark.sparkContext.broadcast((books, cells, held, first, parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cells, _, first, parts = sent.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            at = np.searchsorted(cells, cell)
            ids = batch.column("ids")
            least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]] if len(cell) else cell
            mixed = (least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([pa.array(first[at] + mixed.astype(np.int64) % parts[at]), *batch.columns], ["block", "v", "ids", "cell"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, cells, held, first, parts = sent.value
        large = parts > 1
        for batch in batches:
            limits, wanted = [], []
            for q in matrix(batch.column("v")):
                scores = cell_scores(q, books, cells)
                limits.append(reach(scores, held, candidates))
                seen = ~(scores > limits[-1])
                there = np.zeros(blocks, bool)
                there[first[seen]] = True
                for at in np.flatnonzero(seen & large):
                    there[first[at] : first[at] + parts[at]] = True
                wanted.append(np.flatnonzero(there))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(limits, pa.float64()), pa.array(wanted, pa.list_(pa.int64()))], ["id", "v", "end", "blocks"])

    # a walk is much work for a small row: queries are spread over all cores, which no coalescing takes back
    spread = asking.repartition(max(2, cores), "id")
    walked = scratch.keep(spread.mapInArrow(probe, f"id long, v {kind}, end double, blocks array<long>"), "walked")
    probes = walked.select("id", F.col("v").alias("q"), "end", F.explode("blocks").alias("block"))
    # one row a block
    lots = F.broadcast(probes.groupBy("block").agg(F.ceil(F.count("*") / F.lit(LOT)).cast("int").alias("lots")))
    dealt = probes.join(lots, "block").select("block", F.pmod(F.xxhash64("id"), "lots").cast("int").alias("lot"), "id", "q", "end")
    placed = indexed.select("v", "ids", "cell").mapInArrow(place, f"block long, v {kind}, ids array<long>, cell long")
    copied = placed.join(lots, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "cell", "v", "ids")

    def rerank(asked: pa.Table, kept: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if asked.num_rows and kept.num_rows:
            books = sent.value[0]
            kept = kept.sort_by("cell")
            v, ids = matrix(kept["v"].combine_chunks()), kept["ids"].combine_chunks()
            own_cells, counts = np.unique(kept["cell"].to_numpy(), return_counts=True)
            sizes_of, flat, norms = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), (v**2).sum(1)
            starts = np.cumsum(sizes_of) - sizes_of
            queries, owners, ends = matrix(asked["q"].combine_chunks()), asked["id"].to_pylist(), asked["end"].to_pylist()
            for i in range(0, len(owners), ASKED):
                near = norms - 2 * queries[i : i + ASKED] @ v.T
                for own, q, end, close in zip(owners[i : i + ASKED], queries[i : i + ASKED], ends[i : i + ASKED], near, strict=True):
                    rows = np.flatnonzero(np.repeat(~(cell_scores(q, books, own_cells) > end), counts))
                    if len(rows) > k + 1:  # k + 1 entries hold k ids beside the query's own; those that rounding may have put behind them stay
                        some = close[rows]
                        blur = 8 * dim * np.finfo(float).eps * (norms[rows].max() + (q**2).sum())
                        rows = rows[~(some > np.partition(some, k)[k] + blur)]
                    score = np.sqrt(((v[rows] - q) ** 2).sum(1))
                    found = [(s, x) for r, s in zip(rows.tolist(), score.tolist(), strict=True) for x in flat[starts[r] : starts[r] + sizes_of[r]].tolist() if x != own]
                    out.extend((own, x, s) for s, x in heapq.nsmallest(k, found))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    meet = lambda side: side.repartition(max(cores, min(blocks, 2048)), "block", "lot").groupBy("block", "lot")
    found = meet(dealt).cogroup(meet(copied)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
