"""The corpus pipeline: five operators, each on what the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last return the columns of documents;
the last adds token_ids, and its text is decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, line_dedup, mixing, shingles, toxicity
from quern.llm.common import cut, drop, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the classifier learns from the labels of those that are here."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first; documents all stay."""
    return line_dedup.without_recurring(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles alike to 0.8, or nearly equal SimHashes."""
    return shingles.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights by repeating and leaving out documents."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded, and decoded again."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", reject_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", drop_copies), ("mixing", mix_sources), ("BPE", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # the next stage reads files, as its row ids ask for; all else of this one goes
            docs = keep(cut(stage(spark, docs, sf_dir)))
        if before:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the templates or the components; tests hold run() against plain versions.
ORACLE_SQL = None
