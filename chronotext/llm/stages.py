"""The pipeline's stages: (spark, docs, sf_dir) -> the documents that stay, and at last their packed pieces.

Each stage works on all that its predecessor kept and calls one operator; all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import decontamination, packing, quality_rules, simhash
from chronotext.llm import quality_classifier as classifier


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores below 0.5; it learns from the labels of ``sf_dir``."""
    return classifier.keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the plain rules or lie far outside their language and source."""
    return quality_rules.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, at most four differing bits of their
    fingerprints or shingle sets that overlap by 0.8."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and offset."""
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.place(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
