"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters per language in ``2 ** BITS`` hash buckets; the
counts are summed by Spark (language, bucket), and the resulting log-probability matrix, whose
size is fixed by the number of languages and buckets, is broadcast. Scoring gathers the rows of
a batch's n-grams from that matrix and sums them per document.

Training uses every eligible row up to MAX_TRAIN_ROWS; beyond that, a hash of the key keeps an
evenly spread sample of about that size, so the fit costs the same at any corpus size.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; without any
labelled training row every document is ``und``; equal scores go to the smallest language name;
rows are scored one by one, so repeats agree; a very long text is taken in parts; other columns pass through unless they carry the
name of an output column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16
ORDERS = (1, 2, 3)
MAX_TRAIN_ROWS = 20_000
ALPHA = 0.5
CHUNK = 1 << 21
UNDETERMINED = "und"


def grams(text: str, part: int = CHUNK // 4) -> Iterator[np.ndarray]:
    """Buckets of every n-gram of the text, lower-cased, with a space at either end; a long text gives them in parts of bounded size."""
    whole, most = f" {text.lower()} ", max(ORDERS)
    for k in range(0, len(whole), part):
        # a part takes up the characters before it whose n-grams end in it
        before = min(k, most - 1)
        codes = np.frombuffer(whole[k - before : k + part].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        found, rolled = [], np.zeros(len(codes), np.uint64)
        for n in range(1, most + 1):
            rolled = rolled[: max(len(codes) - n + 1, 0)] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            if n in ORDERS:
                own = rolled[max(before - n + 1, 0) :]
                found.append(((own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32))
        yield np.concatenate(found)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order, and their (buckets x languages) log probabilities with the prior in the last row."""
    eligible = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    total = eligible.count()
    share = min(1.0, max_rows / max(total, 1))
    sample = eligible.where((F.pmod(F.xxhash64("k"), F.lit(1_000_003)) < F.lit(share * 1_000_003)) | F.lit(share >= 1)).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    into = sums.setdefault(name, np.zeros(1 << BITS, np.int64))
                    for part in grams(t):
                        into += np.bincount(part, minlength=1 << BITS)
                    rows[name] = rows.get(name, 0) + 1
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(n[at], rows[name]))], ["l", "b", "n"])

    totals = sample.mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    got = totals.toPandas()  # at most languages x buckets rows
    names = sorted(got.l.unique())
    counts = np.zeros(((1 << BITS) + 1, len(names)))
    counts[got.b.to_numpy(), [names.index(x) for x in got.l]] = got.n
    logs = np.empty_like(counts)
    if names:
        logs[:-1] = np.log((counts[:-1] + ALPHA) / (counts[:-1].sum(0) + ALPHA * (1 << BITS)))
        logs[-1] = np.log(counts[-1] / counts[-1].sum())
    return names, logs.astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language or ``und``) and score, the posterior probability of lang_pred."""
    names, logs = model
    held = docs.sparkSession.sparkContext.broadcast(logs)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    order = docs.select(*kept)
    at = kept.index(text)
    schema = T.StructType([*order.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            langs, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            sums = np.zeros((batch.num_rows, len(names)))
            known, rows, found, size = [], [], [], 0

            def flush():
                if rows:
                    starts = np.cumsum([len(g) for g in found]) - [len(g) for g in found]
                    np.add.at(sums, rows, np.add.reduceat(table[np.concatenate(found)], starts, axis=0, dtype=np.float64))
                    rows.clear()
                    found.clear()

            for i, t in enumerate(batch.column(at)):
                t = t.as_py()
                if names and has_letter(t):
                    known.append(i)
                    for part in grams(t):
                        rows.append(i)
                        found.append(part)
                        size += len(part)
                        if size > CHUNK:
                            flush()
                            size = 0
            flush()
            if known:
                total = sums[known] + table[-1]
                odds = np.exp(total - total.max(1, keepdims=True))
                odds /= odds.sum(1, keepdims=True)
                best = odds.argmax(1)
                scores[known] = odds[np.arange(len(known)), best]
                for r, b in zip(known, best, strict=True):
                    langs[r] = names[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores)], schema=pa.schema([*batch.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    return order.mapInArrow(score, schema)
