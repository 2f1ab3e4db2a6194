"""Packing by concatenate and cut.

All token ids form one global row, in the order of the partitions and of the rows inside each.
The first pass tokenises and writes the ids with each row's place inside its partition; the
partitions' token totals, one row each, become prefix sums, which make every place global. The
second pass cuts at the multiples of the window: each document's pieces follow from its global
place alone, so nothing but the totals is shuffled. All windows but the last are full.

Defined cases: a null text counts as empty; an empty text is the end id alone; an empty table has
no pieces; repeated rows are packed one by one; a text of any length is cut over as many windows
as it needs; only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmatch.llm.bpe import as_binary, slices
from landmatch.llm.common import shared_folder
from landmatch.llm.wordbpe import word_vocabulary

END = 2
WINDOW = 4096
#: Partition totals are broadcast up to this many (16 bytes each); beyond, they are joined by a shuffle.
MAX_BROADCAST = 500_000


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(key, part, place, tokens, ids): the partition's number, the tokens before the row there, and the ids as little-endian unsigned 32-bit integers."""
    order = docs.select(F.col(key), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1):
                ids, n = word_vocabulary(path).encode(batch.column(1))
                flat = np.insert(ids.astype("<u4"), np.cumsum(n), end)
                n = n + 1
                starts = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(starts), pa.array(n), as_binary(flat.view(np.uint8), n * 4)],
                    [key, "part", "place", "tokens", "ids"],
                )

    kind = dict(order.dtypes)[key]
    return order.mapInArrow(run, f"`{key}` {kind}, part long, place long, tokens long, ids binary")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): one row per piece of a document in a window."""
    spark = docs.sparkSession
    at = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenized(docs, path, key, text, end).write.option("compression", "zstd").parquet(at)
    held = spark.read.parquet(at)
    totals = held.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if totals.count() <= MAX_BROADCAST else bases
    begins = F.col("base") + F.col("place")
    first, last = F.floor(F.col("begins") / window), F.floor((F.col("begins") + F.col("tokens") - 1) / window)
    cut = (
        held.join(bases, "part")
        .select(key, "tokens", "ids", begins.alias("begins"))
        .select(key, "tokens", "ids", "begins", F.explode(F.sequence(first, last)).alias("sequence_id"))
        .withColumn("from", F.greatest(F.col("begins"), F.col("sequence_id") * window))
        .withColumn("to", F.least(F.col("begins") + F.col("tokens"), (F.col("sequence_id") + 1) * window))
    )
    start, length = F.col("from") - F.col("begins"), F.col("to") - F.col("from")
    return cut.select(
        key,
        start.alias("start"),
        length.alias("length"),
        F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        (F.col("from") - F.col("sequence_id") * window).alias("offset"),
    )


def sequences(pieces: DataFrame, key: str = "doc_id", window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, ids padded to the window, boundaries): the windows themselves with their boundary records; a window has at most ``window`` pieces."""
    boundary = F.struct("offset", F.col(key), "start", "length")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", boundary.alias("b"), "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    filler = pad.to_bytes(4, "little") * window
    padded = F.substring(F.concat(joined, F.lit(filler)), 1, 4 * window)
    return rows.select("sequence_id", padded.alias("ids"), F.transform("p", lambda x: x["b"]).alias("boundaries"))
