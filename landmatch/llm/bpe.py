"""Byte-level BPE encoding and decoding over padded numpy matrices.

A batch of texts is cut into pieces whose encoding does not depend on their surroundings, equal
pieces are encoded once, and all of them together: pieces of similar length form one padded
matrix of token ids, and in every round each row merges its leftmost pair of least rank. Ranks are
looked up in an open-addressing table of hashed pairs. Rows whose merges are done leave the
matrix. Pieces over LONG symbols, whose rounds would cost their length squared, take the same
merges from a heap.

Defined cases: a null text counts as empty and has no ids; special tokens have no meaning in a
text; repeated rows are encoded one by one; an empty table gives an empty result; other columns pass
through unless they carry an output's name. Decoding is exact: the
concatenated bytes of the ids, whether or not they are valid UTF-8.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG = 256
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, LONG)
NONE = np.int32(2**31 - 1)
BATCH_BYTES = 8 << 20
KEEP = 300_000


class Merges:
    """Pair of ids -> (rank, merged id), by hashing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        self.probes = 1
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self.slots(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            taken, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[taken], self.rank[taken], self.merged[taken] = key[put], rank[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += bool(len(todo))

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or of a free one (whose rank is NONE)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self.slots(key)
        got = self.keys[slot]
        off = np.flatnonzero((got != key) & (got >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[off]]
            off = off[(got != key.ravel()[off]) & (got >= 0)]
        return slot

    def one(self, left: int, right: int) -> tuple[int, int]:
        slot = int(self.find(np.array([left]), np.array([right]))[0])
        return int(self.rank[slot]), int(self.merged[slot])


def merge_matrix(ids: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """ids: rows padded with -1. Returns rows and sizes after all merges."""
    out, live = ids.copy(), np.arange(len(ids))
    left = sizes.copy()
    rows, n = ids.copy(), sizes.copy()
    slot = merges.find(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
    rank = np.where(rows[:, 1:] >= 0, merges.rank[slot], NONE)
    while len(live):
        at = rank.argmin(1)
        best = rank[np.arange(len(rows)), at]
        going = best < NONE
        if not going.all():
            done = ~going
            out[live[done]], left[live[done]] = np.pad(rows[done], ((0, 0), (0, out.shape[1] - rows.shape[1])), constant_values=-1), n[done]
            rows, n, live, at, rank, slot = rows[going], n[going], live[going], at[going], rank[going], slot[going]
            width = int(n.max()) if len(n) else 0
            rows, rank, slot = rows[:, :width], rank[:, : max(width - 1, 0)], slot[:, : max(width - 1, 0)]
            if not len(live):
                break
        every = np.arange(len(rows))
        merged = merges.merged[slot[every, at]]
        # close the gap: the columns after the pair move one to the left
        column = np.arange(rows.shape[1] - 1)
        moved = np.where(column[None, :] > at[:, None], rows[:, 1:], rows[:, :-1])
        moved[every, at] = merged
        rows = np.concatenate([moved, np.full((len(rows), 1), -1, rows.dtype)], 1)
        pair = np.arange(rank.shape[1] - 1)
        later = pair[None, :] > at[:, None]
        rank = np.concatenate([np.where(later, rank[:, 1:], rank[:, :-1]), np.full((len(rows), 1), NONE, rank.dtype)], 1)
        slot = np.concatenate([np.where(later, slot[:, 1:], slot[:, :-1]), np.zeros((len(rows), 1), slot.dtype)], 1)
        n = n - 1
        # only the pairs beside the merged id are new
        for beside in (at - 1, at):
            ok = np.flatnonzero((beside >= 0) & (beside + 1 < n))
            fresh = merges.find(rows[ok, beside[ok]], rows[ok, beside[ok] + 1])
            rank[ok, beside[ok]], slot[ok, beside[ok]] = merges.rank[fresh], fresh
        gone = np.flatnonzero(at + 1 >= n)
        inside = gone[at[gone] < rank.shape[1]]
        rank[inside, at[inside]] = NONE
    return out, left


def merge_long(ids: list[int], merges: Merges) -> list[int]:
    """The same merges for one long row, from a heap of (rank, position) over a linked list."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    row = np.array(ids)
    slot = merges.find(row[:-1], row[1:])
    pairs = {}
    heap = [(int(r), i, ids[i], ids[i + 1], int(m)) for i, (r, m) in enumerate(zip(merges.rank[slot], merges.merged[slot], strict=True)) if r < NONE]
    heapq.heapify(heap)
    ids = list(ids)
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = m, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                pair = (ids[k], ids[after[k]])
                if pair not in pairs:
                    pairs[pair] = merges.one(*pair)
                r, merged = pairs[pair]
                if r < NONE:
                    heapq.heappush(heap, (r, k, *pair, merged))
    return [x for x in ids if x >= 0]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0]+sizes[0]-1, starts[1] .. and so on."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def merge_rows(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """symbols: initial ids of all rows one after another. Returns the ids and sizes after the merges."""
    starts = np.cumsum(sizes) - sizes
    parts: list[np.ndarray] = []
    of: list[np.ndarray] = []
    left = sizes.copy()
    low = 1
    one = np.flatnonzero(sizes == 1)
    parts.append(symbols[starts[one]])
    of.append(one)
    for width in WIDTHS:
        chosen = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for k in range(0, len(chosen), max(1, (1 << 21) // width)):
            rows = chosen[k : k + max(1, (1 << 21) // width)]
            matrix = np.full((len(rows), width), -1, np.int32)
            r = np.repeat(np.arange(len(rows)), sizes[rows])
            matrix[r, ragged(np.zeros(len(rows), np.int64), sizes[rows])] = symbols[ragged(starts[rows], sizes[rows])]
            merged, n = merge_matrix(matrix, sizes[rows], merges)
            left[rows] = n
            parts.append(merged[merged >= 0])
            of.append(np.repeat(rows, n))
    for row in np.flatnonzero(sizes > low).tolist():
        ids = merge_long(symbols[starts[row] : starts[row] + sizes[row]].tolist(), merges)
        left[row] = len(ids)
        parts.append(np.array(ids, np.int32))
        of.append(np.full(len(ids), row))
    rows = np.concatenate(of)
    return np.concatenate(parts)[np.argsort(rows, kind="stable")].astype(np.int32), left


#: White space of the pattern's \s (fixed values: the Unicode property White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


class Vocabulary:
    """Ranks of a tiktoken file and the pattern that splits a text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for token, rank in tokens.items():
            self.bytes[rank] = token
        self.first = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        found = [(tokens[t[:k]], tokens[t[k:]], r) for t, r in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens]
        a, b, r = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.merges = Merges(a, b, r.astype(np.int32), r.astype(np.int32))
        sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        # the pattern's \s is White_Space; the module's own also holds U+001C to U+001F
        spaces = regex.escape(WHITE, special_only=False)
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}\\p{{L}}\\p{{N}}]").replace(r"(?!\S)", f"(?=[{spaces}]|\\Z)").replace(r"\s", f"[{spaces}]"))
        self.known: dict[str, np.ndarray] = {}

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        split = [self.pattern.findall(p) for p in pieces]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = pa.array([x for s in split for x in s], pa.string()).dictionary_encode()
        words, code = flat.dictionary, flat.indices.to_numpy()
        raw = words.cast(pa.binary())
        sizes = pc.binary_length(raw).to_numpy().astype(np.int64) if len(raw) else np.empty(0, np.int64)
        symbols = self.first[np.frombuffer(b"".join(raw.to_pylist()), np.uint8)] if len(raw) else np.empty(0, np.int32)
        ids, n = merge_rows(symbols, sizes, self.merges)
        starts = np.cumsum(n) - n
        of_word = n[code]
        ids = ids[ragged(starts[code], of_word)]
        ends = np.append(0, np.cumsum(of_word))[np.append(0, np.cumsum(counts))]
        return ids, np.diff(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; a null text has none.

        A text is cut before every single space that stands between two others than white space:
        the pattern never matches across such a place, so the pieces are encoded on their own.
        Texts with other runs of white space around a space stay whole.
        """
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, f"[{WHITE}] |^ "))
        cut = pc.split_pattern(pc.if_else(plain, texts, ""), " ")
        sizes = pc.list_value_length(cut).to_numpy().astype(np.int64)
        first = np.zeros(int(sizes.sum()), bool)
        first[np.cumsum(sizes) - sizes] = True
        flat = cut.flatten()
        marked = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise("", flat, " "))
        del cut
        # every text's pieces, with the whole text in place of the first piece of those left whole
        whole = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        coded = marked.dictionary_encode()
        pieces, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        del marked, coded, flat
        if len(whole):
            code[(np.cumsum(sizes) - sizes)[whole]] = len(pieces) + np.arange(len(whole))
            pieces += texts.take(pa.array(whole)).to_pylist()
        ids, n = self.encode_pieces(pieces)
        starts = np.cumsum(n) - n
        of_piece = n[code]
        ends = np.append(0, np.cumsum(of_piece))[np.append(0, np.cumsum(sizes))]
        return ids[ragged(starts[code], of_piece)], np.diff(ends)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, one after another, and how many each has."""
        sizes = self.sizes[ids]
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n))]
        return self.joined[ragged(self.starts[ids], sizes)], np.diff(ends)


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose column holds about ``most`` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def as_binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of bytes from their concatenation."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _mapped(df: DataFrame, column: str, added: list[tuple[str, T.DataType]], work) -> DataFrame:
    names = [a for a, _ in added]
    order = df.select(*[c for c in df.columns if c not in names])
    at = order.columns.index(column)
    schema = T.StructType([*order.schema.fields, *(T.StructField(a, t) for a, t in added)])
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                fields = [pa.field(a, kinds[t.simpleString()]) for a, t in added]
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(at))], schema=pa.schema([*batch.schema, *fields]))

    return order.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens and ids (binary: little-endian unsigned 32-bit ids of the whole text)."""

    def work(texts):
        ids, n = vocabulary(path, pattern).encode(texts)
        return [pa.array(n), as_binary(ids.astype("<u4").view(np.uint8), n * 4)]

    return _mapped(df, text, [("n_tokens", T.LongType()), ("ids", T.BinaryType())], work)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary): the bytes that the ids stand for."""

    def work(rows):
        rows = pc.fill_null(rows, b"")
        n = pc.binary_length(rows).to_numpy().astype(np.int64) // 4
        flat = np.frombuffer(b"".join(rows.to_pylist()), "<u4").astype(np.int64)
        return [as_binary(*vocabulary(path, pattern).decode(flat, n))]

    return _mapped(df, ids, [("decoded", T.BinaryType())], work)
