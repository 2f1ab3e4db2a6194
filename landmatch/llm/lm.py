"""Language-model scoring: subword lattice likelihood, beside an additive word unigram.

A text is lower-cased (A to Z), cut into words at white space, and closed by one end token. Two
models learn from the training rows:

* base: word counts c of N training tokens with V distinct ones, log10((c+0.5)/(N+0.5(V+1)));
* lattice: every word is a string of bytes led by a word mark. All its segmentations into pieces of
  an existing subword vocabulary count; a piece's score is its log share of the training words'
  pieces. The forward recursion in log space gives the marginal probability over segmentations.
  Pieces never cross a word mark, so a document's probability is the product over its words.

Plan. Words are counted per Arrow batch and summed by Spark; the word table holds every distinct
word once, where the lattice scores it once. Documents then meet the word table: words that make up
at least 1/HEAVY of all tokens (so at most HEAVY, and short ones only) are broadcast and scored in
place; all others are joined as one row per (batch, word) that lists the rows it stands in.

Defined cases: a null text counts as empty and is the end token alone; without training rows every
count is 0 and V is 0; repeated rows are scored one by one; an empty table gives an empty result; only key and text are
read, so other columns may have any name. A text may be of any length, and so may a word: its time grows in
proportion to its length, and its scoring takes some tens of megabytes beside the word itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmatch.llm.bpe import ragged, slices
from landmatch.llm.common import shared_folder

HEAVY = 50_000
HEAVY_BYTES = 64
END = " "  # no word holds a space
SLICE_BYTES = 24 << 20
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 18
#: Words of at least LONG bytes are taken in blocks of SPAN bytes, BLOCKS at once.
LONG, SPAN, BLOCKS = 2048, 32, 1024


class Lattice:
    """Log probabilities of pieces (bytes, the word mark as a space), in a hash table by (hash of the bytes)."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        both: dict[bytes, float] = {}
        for piece, log in zip(pieces, logs.tolist(), strict=True):
            both[piece] = float(np.logaddexp(both[piece], log)) if piece in both else log
        self.longest = max(map(len, both))
        hashes = np.array([self.hash(p) for p in both], np.uint64)
        values = np.array(list(both.values()))
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -np.inf)
        for h, v, at in zip(hashes.tolist(), values.tolist(), self.slot(hashes).tolist(), strict=True):
            while self.keys[at]:
                at = (at + 1) % SLOTS
            self.keys[at], self.values[at] = h, v

    @staticmethod
    def hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(BASE) + b + 1) & (1 << 64) - 1
        return h

    @staticmethod
    def slot(h):
        return np.multiply(h ^ h >> np.uint64(29), np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.slot(h).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == h, self.values[at], -np.inf)
        off = np.flatnonzero((got != h) & (got != 0))
        while len(off):
            at[off] = (at[off] + 1) % SLOTS
            got = self.keys[at[off]]
            hit = got == h[off]
            out[off[hit]] = self.values[at[off[hit]]]
            off = off[~hit & (got != 0)]
        return out

    def alphas(self, rows: np.ndarray) -> np.ndarray:
        """Logs of the summed probabilities of all segmentations of every prefix; rows: bytes of equally long strings."""
        n, size = rows.shape
        prefix = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * BASE + rows[:, j] + np.uint64(1)
        reach = min(self.longest, size)
        power = np.uint64(1)
        scores = []
        for length in range(1, reach + 1):
            power = np.uint64(int(power) * int(BASE) & (1 << 64) - 1)
            scores.append(self.find((prefix[:, length:] - prefix[:, : size + 1 - length] * power).ravel()).reshape(n, -1))
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, size + 1):
            into = np.stack([alpha[:, j - k] + scores[k - 1][:, j - k] for k in range(1, min(j, reach) + 1)])
            top = into.max(0)
            alpha[:, j] = top + np.log(np.exp(into - top).sum(0))
        return alpha

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self.alphas(rows)[:, -1]

    def forward_long(self, row: np.ndarray) -> float:
        """forward of one long string, in memory that does not grow with it.

        The last ``longest`` alphas are all that later ones need. A block of SPAN bytes takes them to those at its
        end by a matrix, and the matrices of BLOCKS blocks are made at once, a byte of all blocks at a time.
        """
        reach, head = self.longest, len(row) % SPAN
        state = np.append(np.full(reach, -np.inf), self.alphas(row[None, :head])[0])[-reach:]
        powers = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(1, reach + 1)]
        padded = np.append(np.zeros(reach - 1, np.uint8), row)
        for first in range(head, len(row), SPAN * BLOCKS):
            starts = np.arange(first, min(first + SPAN * BLOCKS, len(row)), SPAN)
            data = padded[starts[:, None] + np.arange(reach - 1 + SPAN)]
            prefix = np.zeros((len(starts), reach + SPAN), np.uint64)
            for j in range(reach - 1 + SPAN):
                prefix[:, j + 1] = prefix[:, j] * BASE + data[:, j] + np.uint64(1)
            piece = np.empty((len(starts), SPAN, reach))  # the piece that starts k alphas after the oldest one
            for k in range(1, reach + 1):
                found = self.find((prefix[:, reach:] - prefix[:, reach - k : reach - k + SPAN] * powers[k - 1]).ravel())
                piece[:, :, reach - k] = np.exp(found).reshape(len(starts), SPAN)
            paths = np.zeros((len(starts), reach, reach + SPAN))
            paths[:, :, :reach] = np.eye(reach)
            scale = np.zeros((len(starts), reach, 1))
            for j in range(SPAN):
                paths[:, :, reach + j] = np.einsum("rbt,rt->rb", paths[:, :, j : reach + j], piece[:, j])
                if j % 8 == 7:  # before anything is too small for a double
                    window = paths[:, :, j + 1 : reach + j + 1]
                    top = window.max(2, keepdims=True)
                    top[top == 0] = 1
                    window /= top
                    scale += np.log(top)
            with np.errstate(divide="ignore"):
                steps = np.log(paths[:, :, SPAN:]) + scale
            for step in steps:
                into = state[:, None] + step
                top = into.max(0)
                top[np.isinf(top)] = 0
                with np.errstate(divide="ignore"):
                    state = top + np.log(np.exp(into - top).sum(0))
        return float(state[-1])

    def log10(self, words: pa.Array) -> np.ndarray:
        raw = words.cast(pa.binary())
        sizes = pc.binary_length(raw).to_numpy().astype(np.int64) + 1
        data = np.frombuffer(b"".join(b" " + w for w in raw.to_pylist()), np.uint8)
        starts, out = np.cumsum(sizes) - sizes, np.empty(len(sizes))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            if size >= LONG:
                out[at] = [self.forward_long(data[k : k + size]) for k in starts[at].tolist()]
                continue
            step = max(1, (1 << 19) // size)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = self.forward(data[starts[some][:, None] + np.arange(size)])
        return out / np.log(10)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word number of each token, and the tokens of each text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = pc.list_value_length(cut).to_numpy().astype(np.int64)
    flat = cut.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), row


def word_table(docs: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """(word, n_all, n_train) of every distinct word, and END with the number of documents."""
    order = docs.select(F.col(text).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, SLICE_BYTES):
                words, code, row = tokens(batch.column(0))
                learns = batch.column(1).to_numpy(zero_copy_only=False)
                every = np.bincount(code, minlength=len(words))
                known = np.bincount(code[learns[row]], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END])]), pa.array(np.append(every, len(learns))), pa.array(np.append(known, learns.sum()))], ["word", "n_all", "n_train"])

    return order.mapInArrow(count, "word string, n_all long, n_train long").groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def pieces_of(path: str) -> tuple[list[bytes], sentencepiece.SentencePieceProcessor]:
    """Surface of every piece; byte pieces stand for their byte, control pieces for none."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        found.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) or model.is_unknown(k) else piece.replace(MARK, " ").encode())
    return found, model


def learn(words: DataFrame, path: str) -> tuple[Lattice, float]:
    """The lattice with its piece scores, and the end token's log10 probability. At most one row per piece reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        sums = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            ids = model.encode(batch.column(0).to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.int64, int(sizes.sum()))
            np.add.at(sums, flat, np.repeat(batch.column(1).to_numpy(), sizes))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["piece", "n"])

    surfaces, model = pieces_of(path)
    training = words.where((F.col("word") != END) & (F.col("n_train") > 0)).select("word", "n_train")
    got = training.mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    ends = words.where(F.col("word") == END).agg(F.sum("n_train")).first()[0] or 0
    n = np.zeros(model.get_piece_size())
    n[got.piece.to_numpy(np.int64)] = got.n.to_numpy(np.float64)
    n[[not s for s in surfaces]] = 0
    used = [k for k, s in enumerate(surfaces) if s]
    total = n[used].sum() + ends + 0.5 * (len(used) + 1)
    return Lattice([surfaces[k] for k in used], np.log((n[used] + 0.5) / total)), float(np.log10((ends + 0.5) / total))


def score(docs: DataFrame, train: Column, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs."""
    spark = docs.sparkSession
    at = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    word_table(docs, train, text).write.parquet(at)
    words = spark.read.parquet(at)
    total, known, every = (int(x or 0) for x in words.agg(F.sum("n_train"), F.count_if(F.col("n_train") > 0), F.sum("n_all")).first())
    lattice, end10 = learn(words, path)
    held = spark.sparkContext.broadcast(lattice)

    def base10(n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (total + 0.5 * (known + 1)))

    def with_lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.log10(batch.column(0)))], ["word", "n_train", "lp"])

    def scored(some: DataFrame) -> DataFrame:
        return some.select("word", "n_train").mapInArrow(with_lattice, "word string, n_train long, lp double")

    is_heavy = (F.col("n_all") * HEAVY >= max(every, 1)) & (F.octet_length("word") <= HEAVY_BYTES)
    real = F.col("word") != END
    heavy = scored(words.where(real & is_heavy)).toArrow().combine_chunks()
    ends = words.where(~real).agg(F.sum("n_train")).first()[0] or 0
    common = spark.sparkContext.broadcast((heavy["word"].combine_chunks(), heavy["n_train"].to_numpy(), heavy["lp"].to_numpy()))
    order = docs.select(F.col(key), F.col(text))
    kind = dict(order.dtypes)[key]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: a word with the rows it stands in, and (under a name no word has) the sums a row has by itself."""
        names, counts, logs = common.value
        part, first = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                found, code, row = tokens(batch.column(1))
                n = batch.num_rows
                uid = (np.int64(part) << 33) + first + np.arange(n)
                first += n
                seat = pc.fill_null(pc.index_in(found, value_set=names), -1).to_numpy().astype(np.int64)[code]
                near = seat >= 0
                sums = np.zeros((n, 4))
                sums[:, 0] = np.bincount(row, minlength=n) + 1
                for column, values in ((1, counts > 0), (2, base10(counts)), (3, logs)):
                    sums[:, column] = np.bincount(row[near], weights=values[seat[near]].astype(float), minlength=n)
                sums += [0, ends > 0, float(base10(np.float64(ends))), end10]
                alone = pa.array([f" {part} {u}" for u in uid.tolist()])
                yield _posted(alone, batch.column(0), np.ones(n, np.int64), uid, np.ones(n, np.int64), sums)
                pair, times = np.unique(code[~near] * n + row[~near], return_counts=True)
                words_at, rows_at = pair // n, pair % n
                used, sizes = np.unique(words_at, return_counts=True)
                yield _posted(found.take(pa.array(used)), None, sizes, uid[rows_at], times, None, batch.column(0).type)

    def _posted(word, keys, sizes, uid, times, sums, key_type=None):
        cut = np.append(0, np.cumsum(sizes)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(t))) for x, t in ((uid, np.int64), (times, np.int32))]
        own = [pa.array(sums[:, k]) if sums is not None else pa.nulls(len(word), pa.float64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([word, keys if keys is not None else pa.nulls(len(word), key_type), *lists, *own], ["word", key, "rows", "times", "tokens", "known", "base", "score"])

    placed = order.mapInArrow(place, f"word string, `{key}` {kind}, rows array<long>, times array<int>, tokens double, known double, base double, score double")
    rare = scored(words.where(real & ~is_heavy))
    met = placed.join(rare, "word", "left").select(key, "rows", "times", "tokens", "known", "base", "score", "n_train", "lp")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("tokens").is_valid()
            alone = batch.filter(own)
            if alone.num_rows:
                yield pa.RecordBatch.from_arrays([alone.column("rows").flatten(), *(alone.column(c) for c in (key, "tokens", "known", "base", "score"))], ["uid", key, "tokens", "known", "base", "score"])
            other = batch.filter(pc.invert(own))
            if other.num_rows:
                sizes = pc.list_value_length(other.column("rows")).to_numpy()
                times = other.column("times").flatten().to_numpy().astype(np.float64)
                uid, of = np.unique(other.column("rows").flatten().to_numpy(), return_inverse=True)
                n = other.column("n_train").to_numpy()
                sums = [np.bincount(of, weights=times * np.repeat(v, sizes), minlength=len(uid)) for v in ((n > 0).astype(float), base10(n), other.column("lp").to_numpy())]
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.nulls(len(uid), other.column(key).type), pa.array(np.zeros(len(uid))), *map(pa.array, sums)], ["uid", key, "tokens", "known", "base", "score"])

    parts = met.mapInArrow(gather, f"uid long, `{key}` {kind}, tokens double, known double, base double, score double")
    sums = parts.groupBy("uid").agg(F.max(key).alias(key), *[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")])
    return sums.select(
        key,
        F.col("tokens").cast("long").alias("n_tokens"),
        F.round("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
