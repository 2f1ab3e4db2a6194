"""Repeated ids and columns that carry the operators' own names."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from landmatch.llm import bpe, lm, packing

TEXTS = [(1, "one two"), (1, "one two"), (1, "three"), (2, None), (3, ""), (4, "four five six")]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in ("start", "part", "tokens", "place", "ids", "n_tokens", "word", "score", "base", "uid", "total", "row", "lp")])


def test_encode(docs):
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = bpe.decode(out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == sorted((k, t or "") for k, t in TEXTS)
    assert {r["word"] for r in got} == {"clash"}
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)


def test_pack(docs):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4).collect()
    wanted = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), window=4).collect()
    key = lambda r: (r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"])
    assert sorted(map(key, got)) == sorted(map(key, wanted))
    assert sum(r["start"] == 0 for r in got) == len(TEXTS)


def test_score(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    key = lambda r: (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9))
    got = sorted(map(key, lm.score(docs, F.lit(True), path).collect()))
    assert got == sorted(map(key, lm.score(docs.select("doc_id", "text"), F.lit(True), path).collect()))
    assert [(k, n) for k, n, *_ in got] == sorted((k, len((t or "").split()) + 1) for k, t in TEXTS)
