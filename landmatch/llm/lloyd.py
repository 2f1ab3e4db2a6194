"""Lloyd's clustering in whole numbers: the same centroids whatever the partitions and their order.

The driver holds the centroids, k times the dimension, and sends them to every task. A task computes the integer squared
differences from each centroid in NumPy, and takes the nearest, of equal ones the lowest index; it returns one sum
per cluster, which groupBy adds up. A round is one pass over the vectors; nothing else is kept between rounds, so a lost
executor costs its tasks only.

Sums are exact: a partial sum is cut into limbs of LIMB bits, each summed in its own row, and the driver puts them
together again. Components within +-2^26 are computed in 64 bits, batches with larger ones in whole numbers of
Python.

Defined cases: vectors that are null, of another length, or have null or non-finite components take no part; a null
id comes last when seeds are drawn, and rows of one id are drawn in the order of their components; fewer vectors than k
give as many clusters; a distance or sum beyond 64 bits is null; an empty table gives an empty result; only the two
columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, "1"
LIMB, SMALL = 40, 1 << 26
LONG = 1 << 63


def kept(vectors: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """(id, vector) of the vectors that take part, components as doubles."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.col(vector).isNotNull() & (F.size(vector) == dimensions)
    return vectors.where(whole & F.forall(vector, usable)).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))


def scaled(column: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as 64-bit numbers, or as Python's own if one is large."""
    x = np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))
    if not len(x) or np.abs(x).max() < SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 2.0**60 else int(np.floor(v * scale))
    return np.frompyfunc(whole, 1, 1)(x)


def nearest(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every vector."""
    large = q.dtype == object or any(abs(c) >= SMALL for row in centroids for c in row)
    q = q.astype(object) if large else q
    all_ = np.stack([((q - np.array(c, object if large else np.int64)) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = all_.argmin(axis=1)
    return best, all_[np.arange(len(q)), best]


def limbs(value: int) -> list[int]:
    """The value in limbs of LIMB bits, lowest first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def sums(vectors: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int], int]]:
    """By cluster with a vector: how many it has, the sums of their components, and of their distances."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for batch in batches:
            q = scaled(batch["vector"], scale)
            if not len(q):
                continue
            best, distance = nearest(q, sent.value)
            for c in np.unique(best):
                mine = best == c
                one = [int(mine.sum()), *(int(x) for x in q[mine].sum(axis=0)), sum(map(int, distance[mine]))]
                total[int(c)] = [a + b for a, b in zip(total[int(c)], one, strict=True)] if int(c) in total else one
        rows = []
        for c, values in total.items():
            cut = [limbs(v) for v in values]
            for k in range(max(map(len, cut))):
                rows.append((c, k, [x[k] if k < len(x) else 0 for x in cut]))
        yield pd.DataFrame(rows, columns=["cluster", "limb", "sums"])

    width = (len(centroids[0]) if centroids else 0) + 2
    parts = vectors.select("vector").mapInPandas(partial, "cluster int, limb int, sums array<bigint>")
    merged = parts.groupBy("cluster", "limb").agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums"))
    found: dict[int, list[int]] = {}
    for row in merged.collect():  # k clusters times a few limbs
        have = found.setdefault(row["cluster"], [0] * width)
        found[row["cluster"]] = [a + (b << LIMB * row["limb"]) for a, b in zip(have, row["sums"], strict=True)]
    return {c: (v[0], v[1:-1], v[-1]) for c, v in found.items()}


def seeds(vectors: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The vectors with the k smallest SHA-256 digests of ``<seed>:<id>``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "vector").limit(k)
    return [[int(x) for x in scaled(pd.Series([row["vector"]]), scale)[0]] for row in first.select("vector").collect()]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of every vector that takes part."""
    read = kept(vectors, key, vector, dimensions)
    centroids = seeds(read, k, seed, scale)
    for _ in range(rounds):
        for c, (n, total, _) in sums(read, centroids, scale).items():
            centroids[c] = [x // n for x in total]
    inertia = {c: x[2] for c, x in sums(read, centroids, scale).items()}
    fits = lambda x: x if x < LONG else None
    whole, last = fits(sum(inertia.values())), centroids
    sent = vectors.sparkSession.sparkContext.broadcast(last)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = scaled(batch["vector"], scale)
            best, distance = nearest(q, sent.value) if len(q) else (np.zeros(0, int), np.zeros(0, int))
            yield pd.DataFrame({"id": batch["id"], "cluster": best.astype("int32"), "distance": pd.array([fits(int(d)) for d in distance], "Int64")})

    told = read.mapInPandas(assign, f"id {read.schema['id'].dataType.simpleString()}, cluster int, distance bigint")
    long = lambda x: F.lit(x).cast("long")
    by_cluster = F.array(*[long(fits(inertia.get(c, 0))) for c in range(len(last))]) if last else F.array().cast("array<bigint>")
    texts = F.array(*[F.lit(",".join(map(str, c))) for c in last]) if last else F.array().cast("array<string>")
    return told.select(F.col("id").alias(key), "cluster", "distance", F.get(by_cluster, F.col("cluster")).alias("cluster_inertia"), long(whole).alias("inertia"), F.get(texts, F.col("cluster")).alias("centroid"))

