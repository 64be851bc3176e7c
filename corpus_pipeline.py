"""From raw documents to a binary training set, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoquarry.llm import decontaminate, mix, quality_rules, simhash, token_codes
from geoquarry.session import materialise

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines pass, without the lines that fail."""
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: three-word SimHash, three bits at most."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their weights."""
    return mix.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: place, length and checksum of each document."""
    return token_codes.read_tokens(token_codes.write_tokens(docs, VOCABULARY))


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("mix_sources", mixture),
    ("token_codes", token_files),
]

#: The stages hash, align and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
