"""From raw documents to token ids: rules, exact and near duplicates, mixing, encoding.

Every stage works on all that the one before it kept, and its decisions take effect: what a stage
rejects is gone, and what the mix repeats is there as often. Each stage's result is written as a
Parquet table in the shared folder before the next one reads it, so a lost executor costs at most
the tasks of one stage.

Nulls, empty and long texts, repeated rows and extra columns are handled as the operators'
docstrings say; all stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firnline.llm.bpe import token_digests, vocabulary
from firnline.llm.chosen_path import near_dedup
from firnline.llm.grace import exact_dedup
from firnline.llm.mixing import mix
from firnline.llm.quality import quality_rules
from firnline.staging import stage

SHINGLE_WORDS = 5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, shingle=SHINGLE_WORDS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs, *vocabulary())


STAGES = [
    ("quality_rules", rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Minwise trees, Newton iterations and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
