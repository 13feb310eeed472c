"""A training-data pipeline over documents; each stage calls one operator of tessera.llm and works on what the last kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, jaccard_join, language_id, mixing, runtime, substring_dedup

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Language evidence, shingle similarity, pivotal rounding and byte pairs are beyond SQL; tests compare the stages with
#: brute-force versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each_class(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode_and_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)
    return coded.drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
