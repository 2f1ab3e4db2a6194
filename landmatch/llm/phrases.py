"""Collocations per language: phrases of two and three words, scored against their parts, with exact counts.

Shards. A task cuts its texts into shards of about SHARD_BYTES. Of each it builds the generalised suffix automaton of
the pieces' words, bounded in depth (``Automaton``): its states are classes of word sequences that end at the same
places, with the number of these places, and its suffix links lead to the next longer class of places. The states
are found by sorting the reversed contexts of all places, which gives the tree of suffix links, instead of word by
word. Their sequences of k words, with counts, are added up over all shards.

Levels. Counts go up level by level: words, then pairs, then triples. A phrase that counts has no part under the
least count, so a level breaks the pieces where the level before has fewer. What may count is told by a bit set of
fixed size (FILTER_BITS) that all tasks get: a set bit may be shared by another phrase, which costs rows and no
result, and a full bit set only rules nothing out.

Subsumption. Every candidate of three words sends its count to its two parts of two words, its suffix and its
prefix; a part goes if the largest such count is at least the given share of its own.

Memory in a task is a multiple of SHARD_BYTES; texts beyond it are cut between words, and a slice starts with the
two words before it, which only give context.

Defined cases: a null or empty text has no words; a null language is ``und``; rows of one doc_id, and equal rows,
all count; ties in the score go by count and then by the phrase's UTF-8 bytes; an empty table gives an empty result;
only the two columns named are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmatch.llm.common import Scratch

DEPTH = 3
LEAST, TOP, SHARE = 10, 2000, 50
SHARD_BYTES = 4 << 20
FILTER_BITS = 1 << 26
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
#: 0 for a byte of a word, 1 for a space, 2 for a break between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(SPACES)], KIND[list(BREAKS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SEPARATOR, WORD = re.compile(rb"[\x09-\x0d !,.:;?]"), re.compile(rb"[^\x09-\x0d !,.:;?]+")
COUNTS = "lang string, phrase string, n bigint"


class Automaton:
    """The suffix automaton of word sequences, for sequences of up to ``depth`` words.

    ids: all words in order; reach: how many words, that one included, a sequence that ends there may have (0: none
    ends there). By state: ``count`` of end places, ``end`` (one of them), the lengths ``shortest`` to ``longest`` of
    its sequences, and the suffix ``link`` (-1 for the root).
    """

    def __init__(self, ids: np.ndarray, reach: np.ndarray, depth: int = DEPTH):
        at = np.flatnonzero(reach > 0)
        node, levels = np.zeros(len(at), np.int64), []
        width = int(ids.max(initial=0)) + 1
        for k in range(depth):
            on = reach[at] > k
            at, node = at[on], node[on]
            keys, first, node, count = np.unique(node * width + ids[at - k], return_index=True, return_inverse=True, return_counts=True)
            levels.append((keys // width, at[first], count))
        # from the longest sequences down: one that a longer one continues to the left at all of its places is in that one's state
        state: list[np.ndarray] = [np.zeros(0, np.int64)] * depth
        made = 0
        for k in range(depth - 1, -1, -1):
            count = levels[k][2]
            state[k] = np.full(len(count), -1, np.int64)
            if k + 1 < depth:
                parent, _, longer = levels[k + 1]
                same = longer == count[parent]
                state[k][parent[same]] = state[k + 1][same]
            new = state[k] < 0
            state[k][new] = made + np.arange(new.sum())
            made += int(new.sum())
        self.count, self.end, self.longest, self.shortest = (np.zeros(made, np.int64) for _ in range(4))
        self.link = np.full(made, -1, np.int64)
        for k in range(depth - 1, -1, -1):
            parent, end, count = levels[k]
            of = state[k]
            self.count[of], self.shortest[of] = count, k + 1
            first = self.longest[of] == 0
            self.longest[of[first]], self.end[of[first]] = k + 1, end[first]
            if k:
                up = state[k - 1][parent]
                self.link[of[up != of]] = up[up != of]

    def sequences(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(end, count) of every sequence of k words."""
        here = (self.shortest <= k) & (k <= self.longest)
        return self.end[here], self.count[here]


def last_words(part: bytes, n: int) -> bytes:
    """The end of a text from its n-th last word on."""
    size = 256
    while True:
        tail = part[-size:]
        found = [m.start() for m in WORD.finditer(tail)]
        if len(found) > n or size >= len(part):
            return tail[found[-n] if len(found) >= n else 0 :]
        size *= 4


def slices(text: bytes, most: int = SHARD_BYTES) -> Iterator[tuple[bytes, int]]:
    """A text in slices of about ``most`` bytes, each with the number of leading words that are only context."""
    begin, context = 0, b""
    while begin < len(text):
        cut = SEPARATOR.search(text, begin + most) if len(text) - begin > most else None
        stop = cut.start() if cut else len(text)
        part = context + text[begin:stop]
        yield part, len(WORD.findall(context))
        context, begin = last_words(part, DEPTH - 1) if cut else b"", stop


def words(parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(ids, distinct words, pieces, context) of a shard's slices; pieces tells which words belong together."""
    raw = b"\n".join(p for p, _ in parts)
    data = np.frombuffer(raw, np.uint8)
    kind = KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - begins)))
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])])
    coded = each.dictionary_encode()
    context = np.zeros(len(begins), bool)
    at = 0
    for part, leading in parts:
        if leading:
            first = np.searchsorted(begins, at)
            context[first : first + leading] = True
        at += len(part) + 1
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.searchsorted(np.flatnonzero(kind == 2), begins), context


def hashed(lang: str, found: list[bytes]) -> np.ndarray:
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in found), np.uint64, len(found))


def places(hashes: list[np.ndarray]) -> np.ndarray:
    """Places in the bit set of phrases, from their words' hashes."""
    x = hashes[0].copy()
    for h in hashes[1:]:
        x = x * np.uint64(0x9E3779B97F4A7C15) + h
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) & np.uint64(FILTER_BITS - 1)


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def reaches(size: int, lang: str, ids: np.ndarray, distinct: pa.Array, piece: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """``size`` where a phrase of that many words ends whose parts of one word less may count, otherwise 0."""
    good = np.ones(len(ids), bool)
    if size > 1:
        h = hashed(lang, distinct.to_pylist())
        if size == 2:
            known = holds(bits, places([h]))[ids]
            good[:1] = False
            good[1:] = known[1:] & known[:-1] & (piece[1:] == piece[:-1])
        else:
            pair = np.zeros(len(ids), bool)
            pair[1:] = (piece[1:] == piece[:-1]) & holds(bits, places([h[ids[:-1]], h[ids[1:]]]))
            good[:2] = False
            good[2:] = pair[2:] & pair[1:-1]
    return np.where(good, size, 0)


def shard_counts(size: int, lang: str, parts: list[tuple[bytes, int]], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    ids, distinct, piece, context = words(parts)
    reach = reaches(size, lang, ids, distinct, piece, bits)
    reach[context] = 0
    end, count = Automaton(ids, reach, size).sequences(size)
    for k in range(0, len(end), 65_536):
        e = end[k : k + 65_536]
        columns = [distinct.take(pa.array(ids[e - j])) for j in range(size - 1, -1, -1)]
        phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
        yield pa.record_batch([pa.array([lang] * len(e), pa.string()), phrase, pa.array(count[k : k + 65_536])], names=["lang", "phrase", "n"])


def level(docs: DataFrame, size: int, bits) -> DataFrame:
    """(lang, phrase, n): all occurrences of the phrases of ``size`` words whose parts may count. docs: (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = None if bits is None else bits.value
        shard: dict[str, list[tuple[bytes, int]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in shard.items():
                yield from shard_counts(size, lang, parts, told)
            shard.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part, leading in slices(text.as_py()):
                    shard.setdefault(lang, []).append((part, leading))
                    held += len(part)
                    if held >= SHARD_BYTES:
                        yield from flush()
                        held = 0
        yield from flush()

    return docs.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bit_set(phrases: DataFrame) -> np.ndarray:
    """The bit set of (lang, phrase): FILTER_BITS bits in longs, whatever the number of rows."""

    def at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = hashed(lang, phrase.encode().split(b" "))
                spots.append(places([h[k : k + 1] for k in range(len(h))])[0])
            yield pa.record_batch([pa.array(np.array(spots, np.int64))], names=["at"])

    one = F.lit(1).cast("long")
    long = phrases.select("lang", "phrase").mapInArrow(at, "at bigint").groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = long.toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in decimals, whose division to whole numbers is exact."""
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    read = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    counts = {1: scratch.keep(level(read, 1, None), "1")}
    totals = counts[1].groupBy("lang").agg(F.sum("n").alias("total"))
    for size in range(2, DEPTH + 1):
        bits = spark.sparkContext.broadcast(bit_set(counts[size - 1].where(F.col("n") >= least)))
        counts[size] = scratch.keep(level(read, size, bits).where(F.col("n") >= least), str(size))
        bits.unpersist()

    known = reduce(DataFrame.unionByName, counts.values()).where(F.col("n") >= least)
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice("_w", 1, k), " ").alias("left"), F.expr(f"array_join(slice(_w, {k + 1}, size(_w)), ' ')").alias("right"))
    candidates = reduce(DataFrame.unionByName, [counts[s].select("lang", "phrase", F.col("n").alias("a"), F.lit(s).alias("size")) for s in range(2, DEPTH + 1)])
    cuts = candidates.withColumn("_w", F.split("phrase", " ")).withColumn("_c", F.explode(F.filter(F.array(*[cut(k) for k in range(1, DEPTH)]), lambda x: x.k < F.col("size"))))
    parts = cuts.select("lang", "phrase", "a", "size", "_c.*")
    for side, name in (("left", "l"), ("right", "r")):
        parts = parts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    scored = parts.withColumn("score", score("a", "l", "r"))
    lowest = scored.groupBy("lang", "phrase", "a", "size").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b")).select("lang", "phrase", "a", "size", "_b.score", "_b.l", "_b.r")

    inner = candidates.where(F.col("size") > 2).select("lang", F.split("phrase", " ").alias("_w"), F.col("a").alias("longer"))
    within = inner.select("lang", "longer", F.explode(F.array(F.expr("slice(_w, 1, size(_w) - 1)"), F.expr("slice(_w, 2, size(_w) - 1)"))).alias("_w"))
    covered = within.groupBy("lang", F.array_join("_w", " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    left = lowest.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
