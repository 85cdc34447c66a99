"""Labelled prompt pairs for cache benchmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.series import with_previous, with_row_index

#: Rows of a class that are numbered in one task, about.
PLACE_ROWS = 200_000

# Scale of sentence-similarity scores and the share that counts as a match.
SCORE_SCALE = 5.0
MATCH_SHARE = 0.6


def from_scores(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Scored sentence pairs; a pair matches at six tenths of the scale."""
    return rows.select(
        *keep,
        F.col("sentence1").alias("prompt_a"),
        F.col("sentence2").alias("prompt_b"),
        (F.col("score") / F.lit(SCORE_SCALE) >= MATCH_SHARE).alias("is_match"),
    )


def from_labels(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Paraphrase pairs with a 0/1 label."""
    return rows.select(
        *keep,
        F.col("sentence1").alias("prompt_a"),
        F.col("sentence2").alias("prompt_b"),
        (F.col("label") == 1).alias("is_match"),
    )


def positive_class_pairs(items: DataFrame, label: str, item_id: str) -> DataFrame:
    """Each item of a class with the one before it: n - 1 pairs for a class of n.

    All pairs of a class would be quadratic in its size; the chain covers every item once.
    """
    chained = with_previous(items.select(label, item_id), [label], [item_id], {"a": item_id}, 10_000)
    return chained.where(F.col("a").isNotNull()).select(label, "a", F.col(item_id).alias("b"))


def negative_class_pairs(items: DataFrame, label: str, item_id: str, seed: int = 11) -> DataFrame:
    """Neighbours in a seeded random order that belong to different classes, at most as many as positives."""
    width = 1 << 48
    digest = F.md5(F.concat(F.col(item_id).cast("string"), F.lit(f"#{seed}")))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    shuffled = items.select(F.lit(0).alias("_all"), label, item_id, place.alias("_h"))
    linked = with_previous(shuffled, ["_all"], ["_h", item_id], {"a": item_id, "_l": label}, width)
    crossed = linked.where(F.col("_l") != F.col(label))
    wanted = items.agg((F.count(F.lit(1)) - F.countDistinct(label)).alias("n")).scalar()
    numbered = with_row_index(crossed, ["_all"], ["_h", item_id], "_i", width)
    return numbered.where(F.col("_i") < wanted).select("a", F.col(item_id).alias("b"))


def numbered_in_class(items: DataFrame, label: str, item_id: str) -> DataFrame:
    """Items with their place in the class (``_i``, from 0, by id) and its size (``_n``).

    Classes are numbered in slices of the id's range that hold about PLACE_ROWS rows if ids are spread evenly;
    ids are whole numbers. Rows without label or id are in no class, repeated rows of a class count once.
    """
    known = items.select(label, F.col(item_id).cast("bigint").alias(item_id)).dropna().distinct()
    sizes = known.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), F.min(item_id).alias("_low"), (F.max(item_id) - F.min(item_id) + 1).alias("_span")
    )
    parts = F.ceil(F.col("_n") / PLACE_ROWS)
    place = F.floor((F.col(item_id) - F.col("_low")) / F.ceil(F.col("_span") / parts))
    placed = known.join(sizes, label).withColumn("_part", place).drop("_low", "_span")
    return with_row_index(placed, [label], [item_id], "_i", slice_by=F.col("_part")).drop("_part", "_slice")


def class_pairs(items: DataFrame, label: str, item_id: str, degree: int) -> DataFrame:
    """Pairs (label, a, b) of equal class: each item with the ``degree`` items after it in a ring of its class.

    Rows grow with items x degree, whatever the class sizes. Each pair comes once, a < b; a class of n with
    ``degree`` of n // 2 or more gives all of its n (n - 1) / 2 pairs, a class of one item none.
    """
    placed = numbered_in_class(items, label, item_id)
    # Steps beyond half the ring meet pairs again; in an even ring its half meets every pair twice.
    steps = F.least(F.lit(degree).cast("bigint"), F.floor(F.col("_n") / 2))
    asked = placed.where(steps > 0).withColumn("_d", F.explode(F.sequence(F.lit(1).cast("bigint"), steps)))
    asked = asked.where((F.col("_d") * 2 != F.col("_n")) | (F.col("_i") < F.col("_d")))
    ahead = asked.select(label, F.col(item_id).alias("_x"), F.pmod(F.col("_i") + F.col("_d"), F.col("_n")).alias("_i"))
    met = ahead.join(placed.select(label, "_i", F.col(item_id).alias("_y")), [label, "_i"])
    return met.select(label, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
