"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

Quality rules reject documents, exact dedup keeps one of equal texts, SimHash near-dedup one of each group, the
mix takes words of each source up to its target, and byte-pair encoding turns what is left into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillflow.llm import bpe, exact_dedup, mixing, quality_rules, queries, simhash_bk
from quillflow.llm.scratch import only_result, prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs.select(*COLUMNS))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.kept_documents(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash_bk.representatives(docs.select(*COLUMNS))


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): a document that the mix took in several passes has a row for each.

    One pass encodes and decodes: a task has one Python worker with its memos, not two, and workers outlive their tasks.
    """
    prepare(spark)
    decoded = bpe.round_trip(docs, queries.tokenizer_path())
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("source_mix", source_mix_stage),
    ("bpe", bpe_stage),
]

#: SimHash, the mix's draws and the merges have no SQL form: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again, and what led to it is deleted.

    Nulls in any column, empty texts, repeated rows and extra columns are allowed, and an empty table goes through
    all stages; each stage's operator says what it makes of them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = only_result(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
