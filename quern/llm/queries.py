"""One query an operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, exact_dedup, language, line_dedup, mixing, neighbours, secrets, simhash, token_counts, toxicity


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, d, "documents"))


def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, d, "documents"))


def op3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(_table(spark, d, "embeddings"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), copy="copy", key="shuffle_key")


def op6_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digests(_table(spark, d, "documents"))


def op7_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.digests(_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(_table(spark, d, "documents"))


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.without_recurring(_table(spark, d, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_neighbours, op4_toxicity, op5_mixing, op6_secrets, op7_bpe, op8_language, op9_line_dedup, op10_token_counts)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {"op2_exact_dedup": exact_dedup.SQL, "op5_mixing": mixing.SQL, "op6_secrets": secrets.SQL}
