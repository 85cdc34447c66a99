"""Distances, decays, token overlap, costs and cache keys as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default weights of similarity, recency and importance in a recall.
RECALL_WEIGHTS = (0.6, 0.25, 0.15)
# Punctuation stripped from both ends of a token.
EDGE_PUNCTUATION = r"""[.,!?;:"'()\[\]{}<>]+"""


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 (same direction) to 2 (opposite); null when a vector has no direction."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.lit(1.0) - dot(a, b) / norms)


def similarity_from_distance(distance: Column) -> Column:
    return F.lit(1.0) - distance / 2


def recency_decay(age_s: Column, half_life_s: float) -> Column:
    return F.exp(F.lit(-math.log(2.0)) * age_s / F.lit(half_life_s))


def composite_score(
    similarity: Column,
    age_s: Column,
    importance: Column,
    half_life_s: float,
    weights: tuple[float, float, float] = RECALL_WEIGHTS,
) -> Column:
    """Weighted sum of similarity, recency and importance."""
    w_similarity, w_recency, w_importance = (F.lit(w) for w in weights)
    return (
        w_similarity * similarity
        + w_recency * recency_decay(age_s, half_life_s)
        + w_importance * importance
    )


def token_set(text: Column) -> Column:
    """Distinct lower-case words without edge punctuation."""
    words = F.split(F.lower(text), r"\s+")
    bare = F.transform(
        words, lambda w: F.regexp_replace(w, f"^{EDGE_PUNCTUATION}|{EDGE_PUNCTUATION}$", "")
    )
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def token_set_ascii(text: Column) -> Column:
    """Distinct lower-case words stripped of everything but ``a-z0-9`` at the edges."""
    words = F.split(F.lower(text), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def overlap(query_tokens: Column, tokens: Column) -> Column:
    """Share of the query's tokens found in the other set."""
    n = F.size(query_tokens)
    return F.when(n > 0, F.size(F.array_intersect(query_tokens, tokens)) / n).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def with_cost_micros(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost in micro-dollars; null for models without a price.

    ``usage`` has (model, tokens_in, tokens_out); ``prices`` (model, price_in, price_out) per 1,000 tokens.
    """
    dollars = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / F.lit(1000.0)
    return (
        usage.join(prices, "model", "left")
        .withColumn("cost_micros", F.floor(dollars * F.lit(1e6) + 0.5))
        .drop("price_in", "price_out")
    )


def request_cache_key(
    model: Column,
    messages: Column,
    temperature: Column | None = None,
    top_p: Column | None = None,
    max_tokens: Column | None = None,
    tools: Column | None = None,
) -> Column:
    """SHA-256 of the canonical JSON of a request: keys sorted, absent fields left out.

    ``messages`` is an array of (content, role) structs; ``tools`` an array of structs with a
    ``function.name``, compared in name order. Whole-number settings print without a fraction.
    """

    def number(value: Column | None) -> Column:
        filled = F.coalesce(value, F.lit(1.0)) if value is not None else F.lit(1.0)
        text = filled.cast("double").cast("string")
        return F.regexp_replace(text, r"\.0$", "")

    parts = []
    if max_tokens is not None:
        parts.append(F.when(max_tokens.isNotNull(), F.concat(F.lit('"max_tokens":'), max_tokens.cast("string"))))
    parts.append(F.concat(F.lit('"messages":'), F.to_json(messages)))
    parts.append(F.concat(F.lit('"model":'), _json_text(model)))
    parts.append(F.concat(F.lit('"temperature":'), number(temperature)))
    if tools is not None:
        by_name = F.array_sort(
            tools,
            lambda a, b: F.when(a["function"]["name"] < b["function"]["name"], -1)
            .when(a["function"]["name"] > b["function"]["name"], 1)
            .otherwise(0),
        )
        parts.append(F.when(tools.isNotNull(), F.concat(F.lit('"tools":'), F.to_json(by_name))))
    parts.append(F.concat(F.lit('"top_p":'), number(top_p)))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def _json_text(value: Column) -> Column:
    whole = F.to_json(F.struct(value.alias("v")))
    return F.regexp_extract(whole, r'(?s)^\{"v":(.*)\}$', 1)


def confidence(
    samples: Column,
    rate: Column,
    boundary: Column,
    age_ms: Column,
    target_samples: float = 200.0,
    saturation: float = 0.8,
    freshness_ms: float = 3_600_000.0,
) -> Column:
    """Cube root of sample, signal and freshness components, each within 0..1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    sample = clamp(samples / F.lit(target_samples))
    signal = clamp((rate - boundary) / (F.lit(saturation) - boundary))
    fresh = F.when(age_ms <= 0, 1.0).otherwise(clamp(F.lit(1.0) - age_ms / F.lit(freshness_ms)))
    product = sample * signal * fresh
    return F.when(product > 0, F.least(F.lit(1.0), F.cbrt(product))).otherwise(F.lit(0.0))
