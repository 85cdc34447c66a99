"""End-to-end retrieval evaluation and cache replay, composed of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.scoring import cosine_distance, token_set_ascii
from fleetscope.operators import memory, semantic
from fleetscope.operators.knn import knn


def replay_pairs(pairs: DataFrame) -> DataFrame:
    """Paired replay: prompt b looks up the entry of prompt a alone. (pair_id, a, b embeddings, expected)."""
    return pairs.select("pair_id", "expected", cosine_distance(F.col("embedding_b"), F.col("embedding_a")).alias("distance"))


def replay_dense(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Dense replay: every query looks into the whole store; a match is right when the labels agree.

    ``queries`` has (query_id, embedding, label); ``entries`` (entry_id, embedding, label).
    """
    nearest = knn(queries, entries, 1)
    labels = entries.select("entry_id", F.col("label").alias("_label"))
    return (
        queries.select("query_id", "label")
        .join(nearest, "query_id", "left")
        .join(labels, "entry_id", "left")
        .select("query_id", F.coalesce(F.col("_label") == F.col("label"), F.lit(False)).alias("expected"), "distance")
    )


def benchmark(results: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    return semantic.threshold_sweep(results, thresholds)


def rerank_pool(questions: DataFrame, chunks: DataFrame, pool: int) -> DataFrame:
    """Over-fetched pool of each question in hybrid order.

    ``questions`` has (query_id, embedding, text); ``chunks`` (entry_id, embedding, text, session_id, day).
    """
    near = knn(questions, chunks, pool)
    details = chunks.select(
        "entry_id", token_set_ascii(F.col("text")).alias("_chunk_tokens"), F.col("text").alias("chunk_text"), "session_id", "day"
    )
    asked = questions.select("query_id", token_set_ascii(F.col("text")).alias("_question_tokens"))
    joined = near.join(details, "entry_id").join(asked, "query_id")
    return semantic.hybrid_rerank(joined, "_question_tokens", "_chunk_tokens").drop("_question_tokens", "_chunk_tokens")


def reading_contexts(ranked: DataFrame, asked: DataFrame, k: int, containment: float = 0.9) -> DataFrame:
    """Dated contexts for a reader: as-of filter, near-duplicate removal, first ``k``, chronological order."""
    dated = memory.as_of(ranked.join(asked, "query_id"))
    kept = memory.dedupe_containment(
        dated.select("query_id", "entry_id", "session_id", "day", "position", F.col("chunk_text").alias("text")), containment
    )
    first = kept.where(F.col("picked") <= k).withColumn("position", F.col("picked"))
    ordered = memory.group_chronologically(first)
    texts = ranked.select("query_id", "entry_id", "chunk_text")
    return ordered.join(texts, ["query_id", "entry_id"]).select(
        "query_id",
        "reading_order",
        "entry_id",
        F.concat(F.lit("["), F.col("day").cast("string"), F.lit("] "), "chunk_text").alias("context"),
    )
