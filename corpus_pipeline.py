"""The corpus pipeline: documents through five operators, each stage written and read again.

1. quality: rows that fail the quality rules go; the n-gram tables are those of the stage's own input.
2. toxicity: rows predicted toxic go; the classifier learns from the labelled rows of the stage's own input.
3. near_duplicates: of each group of near copies the row with the smallest doc_id stays.
4. mixing: rows are repeated or left out so that the sources come to their target weights.
5. encoding: every row that is left is encoded, decoded and given with digests of both.

Defined cases are those of the operators. An input without rows gives a result without rows.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import bpe, jaccard, mixing, quality, toxicity
from vacantia.llm.queries import PATTERN, RANKS, table
from vacantia.llm.stored import folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_sample(table(spark, sf_dir, "labels"))
    return quality.reject(docs, quality.as_column(quality.log_ratios(docs, trusted)))


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, RANKS, PATTERN)


STAGES = [
    ("quality_rules", quality_rules), ("toxicity", toxic_texts), ("near_duplicates", near_duplicates),
    ("mixing", mixed), ("bpe", encoded),
]
#: SQL can't express the learned and the iterative stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work = f"{folder(spark)}/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES, 1):
        stage(spark, docs, sf_dir).write.parquet(f"{work}/{number}_{name}")
        docs = spark.read.parquet(f"{work}/{number}_{name}")
    return docs
