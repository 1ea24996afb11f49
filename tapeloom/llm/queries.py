"""The thin queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, languages, packing, phrases, pieces, quality_model, quality_rules, sharding, simhash, substrings, suffixes, tries, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4, seed=42).drop("component")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), least=100)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality_model.scored(docs.select("doc_id", "text"), quality_model.fit(docs))
    return rows.select("row.doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.without_repeats(table(spark, sf_dir, "documents"), least=35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.policy_mask(quality_rules.POLICIES["base"]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", languages.held_out().alias("held_out"))
    model = languages.learn(docs.where("not held_out"))
    return languages.identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", F.size("mixture").alias("n_languages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved_shards(table(spark, sf_dir, "documents"), shards=16, seed=17)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.rebuilt_trie(table(spark, sf_dir, "conversations")).drop("pre", "end")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.without_repeats(table(spark, sf_dir, "documents"), least=200)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, percent=50, most=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_warc, op3_fingerprints, op4_pieces, op5_quality_model, op6_substrings, op7_packing, op8_quality_rules, op9_languages, op10_sharding, op11_trie, op12_suffixes, op13_phrases)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}
