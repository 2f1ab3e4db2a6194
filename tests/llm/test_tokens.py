"""Byte-level BPE, packing and lattice scoring against the libraries and plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landmatch.llm import bpe, lm, packing, registry

ODD = [
    None, "", " ", "\n\n", "word", "I'll  go\tnow 'sx don't 123abc  \n x", "a b\x1cc \x1d\x1e d\x85e f　g  h", "naïve café ÀÉ Ünï ſt ﬁ", "日本語 テキスト🎉👩‍👩‍👧",
    "a" * 3000, "ab " * 5000, "xyz" * 2000 + " " * 700 + "end", "<|endoftext|> <|startoftext|>", "!?" * 500, "İßẞ é", "same", "same",
]
SCHEMA = "doc_id long, text string, ids string, n_tokens string, score string, tokens string, word string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "x", None, "y", "z", None) for k, t in enumerate(ODD)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_of(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def test_bpe_query_equals_the_library(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = registry.op1_byte_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_bpe_of_odd_texts(odd, library):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(odd, path, pattern)
    assert encoded.columns.count("ids") == 1
    for row in bpe.decode(encoded, path, pattern).collect():
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(row.text or ""), row.text
        assert bytes(row.decoded) == (row.text or "").encode()
    assert bpe.encode(odd.limit(0), path, pattern).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abstll1é\x1c　"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_of_any_text(library, text):
    import pyarrow as pa

    vocabulary = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert vocabulary.encode(pa.array([text]))[0].tolist() == library.encode_ordinary(text)


def check_packing(pieces: pd.DataFrame, ids: dict[int, list[int]]):
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for row in pieces.itertuples():
        part = ids[row.doc_id][row.start : row.start + row.length]
        assert row.length == len(part) > 0 and row.doc_tokens == len(ids[row.doc_id])
        assert row.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    full = 0
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        ends = rows["offset"] + rows["length"]
        assert rows["offset"].tolist() == [0, *ends.tolist()[:-1]]
        assert ends.max() <= 4096
        full += ends.max() == 4096
    assert full >= pieces["sequence_id"].nunique() - 1
    assert sorted(pieces["sequence_id"].unique()) == list(range(pieces["sequence_id"].nunique()))


def library_ids(texts: dict[int, str | None]) -> dict[int, list[int]]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items()}


def test_packing_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_packing(registry.op4_packing(spark, small).toPandas(), library_ids(texts))


def test_packing_of_odd_texts(odd):
    pieces = packing.pack(odd.repartition(5, "doc_id"), public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    check_packing(digest.toPandas(), library_ids(dict(enumerate(ODD))))
    rows = packing.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * 4096 for r in rows)
    assert packing.pack(odd.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def brute_scores(texts: dict[int, str | None], learns: set[int], lattice, end10: float):
    counts: Counter = Counter()
    for k in learns:
        counts.update([*words_of(texts[k]), " "])
    total, known = sum(counts.values()), len(counts)

    def base(word):
        return math.log10((counts[word] + 0.5) / (total + 0.5 * (known + 1)))

    def marginal(word: str) -> float:
        raw = b" " + word.encode()
        alpha = [0.0] + [-math.inf] * len(raw)
        for j in range(1, len(raw) + 1):
            into = [alpha[i] + lattice[raw[i:j]] for i in range(j) if raw[i:j] in lattice]
            top = max(into)
            alpha[j] = top + math.log(sum(math.exp(x - top) for x in into))
        return alpha[-1] / math.log(10)

    memo: dict[str, float] = {}
    out = {}
    for k, t in texts.items():
        words = words_of(t)
        for w in set(words) - memo.keys():
            memo[w] = marginal(w)
        out[k] = (len(words) + 1, sum(counts[w] > 0 for w in [*words, " "]), total, sum(map(base, [*words, " "])), sum(memo[w] for w in words) + end10)
    return out


def piece_logs(spark, texts, learns):
    """The lattice's scores learnt in plain Python, from the library's best segmentations of the training words."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    surfaces, model = lm.pieces_of(path)
    counts = Counter(w for k in learns for w in words_of(texts[k]))
    n: dict[int, int] = defaultdict(int)
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    for word, times in counts.items():
        for piece in processor.encode(word):
            n[piece] += times
    used = [k for k, s in enumerate(surfaces) if s]
    total = sum(n[k] for k in used) + len(learns) + 0.5 * (len(used) + 1)
    lattice: dict[bytes, float] = {}
    for k in used:
        log = math.log((n[k] + 0.5) / total)
        lattice[surfaces[k]] = float(np.logaddexp(lattice[surfaces[k]], log)) if surfaces[k] in lattice else log
    return lattice, math.log10((len(learns) + 0.5) / total)


def test_lattice_scores_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    learns = {k for k in texts if zlib.crc32(str(k).encode()) % 5 != 1}
    wanted = brute_scores(texts, learns, *piece_logs(spark, texts, learns))
    rows = registry.op10_lattice_lm(spark, small).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        n, known, total, base, score = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in learns, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_lattice_scores_of_odd_texts(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = dict(enumerate(ODD))
    learns = {k for k in texts if k % 2}
    short = {k: t for k, t in texts.items() if t is None or max(map(len, words_of(t)), default=0) < 100}
    lattice, end10 = piece_logs(spark, texts, learns)
    rows = {r.doc_id: r for r in lm.score(odd, F.col("doc_id") % 2 == 1, path).collect()}
    assert rows.keys() == texts.keys()
    counts_from = brute_scores({k: t for k, t in texts.items() if k in short or k in learns}, learns, lattice, end10)
    for k in short:
        n, known, total, base, score = counts_from[k]
        assert (rows[k].n_tokens, rows[k].n_known, rows[k].train_tokens) == (n, known, total)
        assert rows[k].base_score == pytest.approx(base, rel=1e-9) and rows[k].score == pytest.approx(score, rel=1e-9)
    assert all(math.isfinite(r.score) for r in rows.values())
    untrained = lm.score(odd, F.lit(False), path).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)
    assert lm.score(odd.limit(0), F.lit(True), path).count() == 0


def test_long_words_are_scored_as_short_ones(monkeypatch):
    """Blocks give what the plain recursion gives, at lengths around whole blocks and with the rarest pieces."""
    monkeypatch.setattr(lm, "BLOCKS", 64)
    rng = np.random.default_rng(3)
    pieces = sorted({bytes(rng.choice(list(b"abcdef/+"), int(n)).astype(np.uint8)) for n in rng.integers(2, 26, 3000)} | {bytes([b]) for b in range(256)})
    for least in (1.0, 1e-13):
        lattice = lm.Lattice(pieces, np.log(rng.dirichlet(np.full(len(pieces), 0.3)) + least))
        for size in (lm.LONG, lm.LONG + 1, lm.SPAN * lm.BLOCKS - 1, lm.SPAN * (lm.BLOCKS + 1) + 5):
            row = rng.choice(list(b"abcdef/+xyz"), size).astype(np.uint8)
            assert lattice.forward_long(row) == pytest.approx(lattice.forward(row[None])[0], rel=1e-11)
    words = ["ab", "ab/" * 1000, "x" * 300_000, "ab/" * 1000]
    got = lattice.log10(pa.array(words))
    assert got[1] == got[3] and np.isfinite(got).all()
    assert got[0] == pytest.approx(lattice.forward(np.frombuffer(b" ab", np.uint8)[None])[0] / math.log(10))
