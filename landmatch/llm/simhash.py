"""SimHash near-duplicates by anchor points.

Fingerprints: 64 bits over word shingles hashed with XXH64. Links: at most ``LIMIT`` differing bits.

Anchors. The 64 bits are two halves of 32; two fingerprints that differ in at most 4 bits differ
in at most 2 in one of the halves. Each half is covered by the product of two perfect Hamming
codes of 15 bits (2 048 codewords each, covering radius 1; the two bits left over are not part of
the anchor). Take two halves at distance 2 or less and a point midway: it is within 1 of both, and
its anchor is within the covering radius of it in each block. So a half that is sent to every
anchor of its neighbourhood of radius 1 (all anchors within covering radius plus its share of
the threshold) meets each partner at an anchor. That is 14 anchors a half on average, among
4 million a half.

Per anchor, fingerprints are compared by 64-bit xor and popcount, and only a spanning forest of
the links found there is emitted, so a dense group gives rows in proportion to its size, not
to its square. Anchors with more than BLOCK fingerprints are cut into blocks and each pair of
blocks becomes a task of its own. Equal fingerprints are one row from the start.

Defined cases: a null or blank text has fingerprint zero and links like any other; a text shorter
than the shingle is one shingle of all its words; an empty table gives an empty result; repeated
rows share their component; other columns pass through unless they carry an output's name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landmatch.llm.common import shared
from landmatch.llm.components import components

SEED = 42
LIMIT = 4
BLOCK = 4096
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = WORD.findall(("" if text is None else text).encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - size + 1].tolist()
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4, out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint as a (signed) long."""
    kept = [c for c in docs.columns if c != out]
    order = docs.select(*kept)
    at = kept.index(text)
    schema = T.StructType([*order.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t.as_py(), size)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], schema=pa.schema([*batch.schema, pa.field(out, pa.int64())]))

    return order.mapInArrow(run, schema)


def hamming_table() -> np.ndarray:
    """Nearest codeword of every 15-bit word in the perfect Hamming code, numbered 0 to 2047.

    The syndrome of a word is the xor of the positions (1 to 15) of its set bits; a syndrome other
    than zero names the bit that differs from the codeword.
    """
    words = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for position in range(1, 16):
        syndrome ^= np.where(words >> (position - 1) & 1, position, 0)
    nearest = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    codes = np.unique(nearest)
    return np.searchsorted(codes, nearest)


def anchors(half: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """31 anchors of each half: that of the half and those of its 30 neighbours in the covered bits (repeats included)."""
    low, high = half & 0x7FFF, half >> 16 & 0x7FFF
    a, b = codes[low].astype(np.int64), codes[high].astype(np.int64)
    near = [a << 11 | b]
    for bit in range(15):
        near.append(codes[low ^ (1 << bit)].astype(np.int64) << 11 | b)
        near.append(a << 11 | codes[high ^ (1 << bit)].astype(np.int64))
    return near


def forest(prints: np.ndarray, limit: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among prints; with split, of the links between prints[:split] and prints[split:]."""
    left = np.arange(len(prints))
    links = []
    if split is None:
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                node = front.pop()
                near = np.bitwise_count(prints[left] ^ prints[node]) <= limit
                if near.any():
                    front.extend(left[near])
                    links.extend((int(node), int(x)) for x in left[near])
                    left = left[~near]
        return links
    sides = [np.arange(split), np.arange(split, len(prints))]
    while len(sides[0]) and len(sides[1]):
        front, sides[0] = [(0, sides[0][0])], sides[0][1:]
        while front:
            side, node = front.pop()
            other = sides[1 - side]
            near = np.bitwise_count(prints[other] ^ prints[node]) <= limit
            if near.any():
                front.extend((1 - side, x) for x in other[near])
                links.extend((int(node), int(x)) for x in other[near])
                sides[1 - side] = other[~near]
    return links


def links(prints: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links among the distinct longs of column fingerprint."""
    codes = hamming_table()
    if limit > 4:
        raise ValueError("the anchors cover thresholds up to 4")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(whole), CHUNK):
                part = whole[k : k + CHUNK]
                bits = part.view(np.uint64)
                for tag, half in enumerate((bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32))):
                    near = np.sort(np.stack(anchors(half.astype(np.int64), codes), 1), axis=1)
                    first = np.ones(near.shape, bool)
                    first[:, 1:] = near[:, 1:] != near[:, :-1]
                    yield pa.RecordBatch.from_arrays([pa.array((near[first] | tag << 22).astype(np.int32)), pa.array(np.repeat(part, first.sum(1)))], ["anchor", "fp"])

    sent = prints.select("fingerprint").mapInArrow(replicate, "anchor int, fp long")
    held = sent.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block).select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # one row per block pair that the fingerprint's block takes part in; anchors of one block stay as they are
    dealt = (
        sent.join(held, "anchor", "left")
        .select("anchor", "fp", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        .select("anchor", "fp", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("own"))
        .select("anchor", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("anchor", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("upper"))
    )
    placed = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "upper")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            found, rest = compared(rows, last=False)
            yield found
        if rest is not None:
            yield compared(rest, last=True)[0]

    def compared(rows: pa.Table, last: bool):
        anchor, i, j = (rows.column(c).to_numpy() for c in ("anchor", "i", "j"))
        fp = rows.column("fp").to_numpy().view(np.uint64)
        new = np.ones(len(fp) + 1, bool)
        new[1:-1] = (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = np.flatnonzero(new)
        if not last:
            cuts = cuts[:-1]
        done = int(cuts[-1]) if len(cuts) else 0
        starts, sizes = cuts[:-1], np.diff(cuts)
        pairs = [np.empty((0, 2), np.uint64)]
        small = starts[(sizes > 1) & (sizes <= 16)]
        lengths = sizes[(sizes > 1) & (sizes <= 16)]
        own = (i == j) if len(fp) else np.empty(0, bool)
        plain = own[small] if len(small) else np.empty(0, bool)
        for n in range(2, 17):
            at = small[plain & (lengths == n)]
            if len(at):
                cell = fp[at[:, None] + np.arange(n)]
                for x in range(n - 1):
                    near = np.bitwise_count(cell[:, x + 1 :] ^ cell[:, x : x + 1]) <= limit
                    r, c = np.nonzero(near)
                    pairs.append(np.stack([cell[r, x], cell[r, x + 1 + c]], 1))
        upper = rows.column("upper").to_numpy(zero_copy_only=False)
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if n > 16 or n > 1 and not own[s]:
                cell = fp[s : s + n]
                tree = forest(cell, limit, None if own[s] else n - int(upper[s : s + n].sum()))
                if tree:
                    pairs.append(cell[np.array(tree)])
        edges = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
        edges = edges[edges[:, 0] != edges[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"]), rows.slice(done).combine_chunks() if not last else None

    found = placed.mapInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, limit: int = LIMIT) -> DataFrame:
    """(key, fingerprint long, component_id): component_id is the smallest key reachable over links."""
    marked = shared(fingerprints(docs.select(key, text), text, size).select(key, "fingerprint"))
    classes = marked.groupBy("fingerprint").agg(F.min(key).alias("_least"))
    edges = shared(links(classes))
    joined = components(edges)  # node, root
    of = classes.join(joined, classes.fingerprint == joined.node, "left").select("fingerprint", "_least", F.coalesce("root", "fingerprint").alias("_root"))
    least = of.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = of.join(least, "_root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select(key, "fingerprint", "component_id")
