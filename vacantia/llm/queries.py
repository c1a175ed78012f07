"""The registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import align, ann, bpe, jaccard, licenses, lm, mixing, packing, pii, quality, spelling, toxicity, urls

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END_ID = 50_256  # free in this vocabulary
PATTERN = public_tokenizers.PATTERN
TOKENIZERS = align.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), PATTERN)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.matrices(table(spark, sf_dir, "documents"), RANKS, PATTERN, END_ID))


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages"), urls.RULES)


ORACLE["op2_url_filters"] = urls.ORACLE


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


ORACLE["op6_mixing"] = mixing.ORACLE


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = quality.trusted_sample(table(spark, sf_dir, "labels"))
    return quality.scored(docs, quality.as_column(quality.log_ratios(docs, trusted)))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


@query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.scored(docs, lm.learned(lm.training_rows(docs)))


@query
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.found(docs, pii.learned(pii.stretches(docs)))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(align.aligned(table(spark, sf_dir, "documents"), TOKENIZERS))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))
