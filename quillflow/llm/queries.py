"""The registered query of each operator and, where DuckDB can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, fm_quality, mixing, quality_rules, simhash_bk, style_tree, substring_dedup, token_store, toxicity
from .scratch import fresh_path, prepare, stored

#: Where the public vocabulary lies; a parameter of the operators.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), tokenizer_path())


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path, tokenizer_path())
    return token_store.checksums(spark, path)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(stored(quality_rules.ledger(documents(spark, sf_dir)), "quality-ledger"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy costs, from a stored ledger."""
    return quality_rules.ablation(stored(quality_rules.ledger(documents(spark, sf_dir)), "quality-ledger"))


def op4_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fm_quality.score(docs, fm_quality.train(docs, labels))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(*exact_dedup.older_half(documents(spark, sf_dir)))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op8_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, 500)
    return style_tree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.repeats(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_token_store": op2_token_store,
    "op3_quality_rules": op3_quality_rules,
    "quality_ablation": quality_ablation,
    "op4_fm_quality": op4_fm_quality,
    "op5_source_mix": op5_source_mix,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_style_tree": op8_style_tree,
    "op9_simhash_bk": op9_simhash_bk,
    "op10_substring_dedup": op10_substring_dedup,
}

SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.SQL,
    "quality_ablation": quality_rules.ABLATION_SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
