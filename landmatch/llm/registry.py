"""Queries of the corpus operators over their whole tables, by name, and SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmatch.llm import ann, bpe, chat, language, licenses, lloyd, lm, oracles, packing, phrases, quality, sharding, simhash, whole_lines
from landmatch.llm.common import fold, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    decoded = bpe.decode(encoded.select("doc_id", "n_tokens", "ids"), path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = whole_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold() != 0))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout keeps a source together, so that the hot source overfills its shard."""
    old = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 40
    placed = sharding.reshard(table(spark, sf_dir, "documents"), old, shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), fold() != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.render(chat.segments(stored.unionByName(added))))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "first_bad_turn", "complete",
    )


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lloyd.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_inverted_multi_index, op3_fuzzy_lines, op4_packing, op5_quality_rules, op6_language_id, op7_simhash, op8_license_scan, op9_resharding, op10_lattice_lm, op11_chat_format, op12_lloyd, op13_collocations)}
ORACLES: dict[str, str] = {"op5_quality_rules": oracles.QUALITY, "op8_license_scan": oracles.LICENCES, "op11_chat_format": oracles.CHAT, "op12_lloyd": oracles.LLOYD, "op13_collocations": oracles.COLLOCATIONS}
