"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is cut into blocks of equally many words. Blocks are seats: sources get them by the
highest quotients target / (2 s + 1), then the shards of each source share its seats by the
same rule on their sizes, so each shard has an integer quota before anything is chosen.
Within a shard, documents stand in a seeded order and the quota's blocks are taken from the
stream of their words, again from its start once it ends.

Highest quotients are not enumerated: rounding target / divisor gives all seats but a few
per source, and only the quotients next to the cut are ranked for the rest.

Only narrow rows (id, source, size, hash) are kept; ranks come from range-partitioned sorts
and windows span one shard of about ROWS_PER_SHARD documents, whatever the source's size.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed, join_side, n_words, with_rank

BLOCK_WORDS = 64
ROWS_PER_SHARD = 1024
#: Weights of sources in order, repeating.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def seeded(seed: str) -> Column:
    """A hash of seed, id and text as 32 hexadecimal digits."""
    return F.md5(
        F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, place, weight, source_size, n_docs, target) from sizes (source, size).

    Targets share the sum of all sizes by weight, but none is over epochs times its
    source's size: the excess is reshared by weight until none is above. The share of one
    weight is an exact fraction of integers; it only grows from round to round.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = with_rank(sources, [F.col("source").asc_nulls_last()], "place")
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int")).cast("long"))
    limit = F.col("source_size").cast("decimal(28,0)") * epochs
    total, heavy = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    left, weight = int(total), int(heavy)

    def above() -> Column:
        return F.col("weight").cast("decimal(9,0)") * F.lit(Decimal(left)).cast("decimal(28,0)") > limit * F.lit(
            Decimal(weight)
        ).cast("decimal(9,0)")

    while True:
        full, light = sources.agg(
            F.sum(F.when(above(), limit).otherwise(0)).cast("decimal(38,0)"), F.sum(F.when(~above(), F.col("weight")))
        ).first()
        if not light or (int(total) - int(full), int(light)) == (left, weight):
            break
        left, weight = int(total) - int(full), int(light)
    target = F.when(above(), F.col("source_size") * float(epochs)).otherwise(
        F.col("weight").cast("double") * float(left) / float(weight)
    )
    return sources.withColumn("target", target)


def seats(rows: DataFrame, group: str, order: str, votes: str, to_give: str) -> DataFrame:
    """rows with seats: to_give (of its group) seats by highest quotients votes / (2 s + 1).

    Equal quotients go by order. Groups without votes get no seats.
    """
    sums = rows.groupBy(group).agg(F.sum(votes).alias("_votes"), F.count("*").alias("_rows"))
    share = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0.0)
    based = rows.join(sums, group).withColumn("_share", share)
    based = checkpointed(based.withColumn("_base", F.floor(F.col(to_give) * F.col("_share") + 0.5)))
    short = based.groupBy(group).agg((F.max(F.when(F.col("_votes") > 0, F.col(to_give)).otherwise(0)) - F.sum("_base")).alias("_short"))
    open_ = based.join(short.where("_short <> 0"), group)
    # no row moves by more than its share of what is missing and of one seat per row
    most = F.ceil(F.col("_share") * (F.abs("_short") + F.col("_rows"))) + 1
    step = F.explode(F.sequence(F.lit(0), most.cast("int"))).alias("_step")
    next_ = open_.select(group, order, "_short", "_base", F.col(votes).alias("_own"), step)
    up = F.col("_own") / (2 * F.col("_base") + 1 + 2 * F.col("_step"))
    down = F.col("_own") / (2 * F.col("_base") - 1 - 2 * F.col("_step"))
    next_ = next_.where((F.col("_short") > 0) | (F.col("_base") > F.col("_step")))
    first = F.when(F.col("_short") > 0, -up).otherwise(down)
    ranked = with_rank(next_.withColumn("_first", first), [F.col(c) for c in (group, "_first", order, "_step")], "_at")
    starts = ranked.groupBy(group).agg(F.min("_at").alias("_start"))
    moved = (
        ranked.join(starts, group)
        .where(F.col("_at") - F.col("_start") < F.abs("_short"))
        .groupBy(group, order)
        .agg(F.sum(F.signum("_short")).cast("long").alias("_moved"))
    )
    out = based.join(moved, [group, order], "left")
    return out.withColumn("seats", (F.col("_base") + F.coalesce("_moved", F.lit(0))).cast("long")).drop(
        "_votes", "_rows", "_share", "_base", "_moved"
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = MOST_EPOCHS,
    block_words: int = BLOCK_WORDS,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, source, text).

    size counts words (0 for a null or empty text), target is the source's, taken is how
    many words the mix takes from the document, repeats counted; it is at most epochs times
    the size. A null source is the last one. Equal rows share an order, which of them comes
    first makes no difference. No words at all: everything is 0.
    """
    sizes = checkpointed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded(seed).alias("mark")))
    sources = source_targets(sizes, weights, epochs)
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    blocks = -(-total // block_words)
    given = seats(
        sources.withColumn("whole", F.lit(0)).withColumn("blocks", F.lit(blocks).cast("long")),
        "whole", "place", "target", "blocks",
    )
    given = checkpointed(
        given.select("source", "place", "source_size", "target", F.col("seats").alias("source_seats"), "n_docs")
        .withColumn("n_shards", F.ceil(F.col("n_docs") / ROWS_PER_SHARD))
    )
    d, g = sizes.alias("d"), given.alias("g")
    placed = join_side(d, g, F.col("d.source").eqNullSafe(F.col("g.source"))).select(
        "doc_id", "size", "mark", "place", "source_size", "target", "source_seats",
        F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), F.col("n_shards")).alias("shard"),
    )
    shards = placed.groupBy("place", "shard").agg(
        F.sum("size").alias("shard_size"), F.max("source_seats").alias("source_seats")
    )
    shards = seats(shards, "place", "shard", "shard_size", "source_seats")
    words = F.least(F.col("seats") * block_words, F.col("shard_size") * epochs)
    quotas = checkpointed(shards.select("place", "shard", "shard_size", words.alias("quota")))
    stream = Window.partitionBy("place", "shard").orderBy("mark", "doc_id")
    rows = join_side(
        placed.drop("source_seats").withColumn("start", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1))),
        quotas, ["place", "shard"],
    )
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0)
    rest = F.col("quota") - whole * F.col("shard_size") - F.coalesce("start", F.lit(0))
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "mark"
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs as often as the mix takes them, columns as they are.

    A document taken for its size k times and r words more gives k whole rows and one of its
    first r words; n_chars follows the text. Documents the mix does not take are left out.
    """
    seed = settings.get("seed", "mix")
    # rows of one id and text are alike to the mix: the nth such row takes the nth amount
    nth = F.row_number().over(Window.partitionBy("_mark").orderBy(F.col("_taken").desc()))
    chosen = mix(docs, **settings).select(
        F.col("mark").alias("_mark"), F.col("size").alias("_size"), F.col("taken").alias("_taken")
    )
    chosen = chosen.withColumn("_nth", nth).where("_taken > 0")
    marked = docs.withColumn("_mark", seeded(seed))
    marked = marked.withColumn("_nth", F.row_number().over(Window.partitionBy("_mark").orderBy("_mark")))
    joined = marked.join(chosen, ["_mark", "_nth"])
    copies = F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))
    joined = joined.withColumn("_copy", F.explode(copies))
    over = F.col("_copy") * F.col("_size") - F.col("_taken")
    blanks = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
    parts = F.split("text", blanks)
    leading = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(parts, F.lit(1), (F.col("_size") - over + leading).cast("int")), "")
    text = F.when(over > 0, cut).otherwise(F.col("text"))
    out = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in docs.columns])
