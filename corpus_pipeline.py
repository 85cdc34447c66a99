"""A training corpus from raw documents: five stages, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import apportion, byte_bpe, importance, near_copies, site_lines
from fleetscope.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws and no toxic word marks; the others go."""
    labels = table(spark, sf_dir, "labels")
    return importance.sampled_documents(docs, labels).where(importance.not_toxic(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source."""
    cleaned = site_lines.drop_boilerplate(docs).drop("n_lines", "n_dropped")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Linked are SimHash fingerprints (of op3) at most 3 bits apart, by postings of positional
    bytes, and five-word shingles similar by 0.8 or more, most of which are further apart.
    """
    return near_copies.one_of_each(docs, bits=3)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return apportion.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.token_digests(docs, rank_file, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("byte-level BPE", tokens),
]

#: Hashed n-gram models, SimHash and MinHash links and BPE merges are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
