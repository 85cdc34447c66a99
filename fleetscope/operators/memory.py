"""Agent memory: recall, reinforcement, eviction, scoping, reading contexts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.scoring import (
    RECALL_WEIGHTS,
    composite_score,
    recency_decay,
    similarity_from_distance,
    token_set_ascii,
)
from fleetscope.operators.knn import knn
from fleetscope.operators.series import with_running_sum

OVERFETCH = 4


def scope_filter(
    thread_id: str | None = None,
    agent_id: str | None = None,
    namespace: str | None = None,
    tags: Sequence[str] = (),
) -> Column | None:
    """Conjunction of the given scope fields; any of the tags suffices."""
    condition: Column | None = None
    for name, value in (("thread_id", thread_id), ("agent_id", agent_id), ("namespace", namespace)):
        if value is not None:
            part = F.col(name) == value
            condition = part if condition is None else condition & part
    if tags:
        part = F.arrays_overlap(F.col("tags"), F.array(*[F.lit(t) for t in tags]))
        condition = part if condition is None else condition & part
    return condition


def recall_candidates(
    queries: DataFrame, memories: DataFrame, k: int = 8, where: Column | None = None, match_on: Sequence[str] = ()
) -> DataFrame:
    """Nearest ``4k`` memories per query before any gate."""
    corpus = memories.withColumnRenamed("item_id", "entry_id")
    return knn(queries, corpus, k * OVERFETCH, where, match_on)


def score_candidates(
    candidates: DataFrame,
    memories: DataFrame,
    now_ms: int,
    k: int = 8,
    threshold: float = 0.25,
    half_life_s: float = 604_800.0,
    weights: tuple[float, float, float] = RECALL_WEIGHTS,
) -> DataFrame:
    """Gate by distance, score by similarity, recency of the last touch and importance, keep the best ``k``."""
    details = memories.select(
        F.col("item_id").alias("entry_id"), "importance", F.greatest("created_ms", "accessed_ms").alias("_touched")
    )
    age = (F.lit(now_ms) - F.col("_touched")) / 1000
    gated = (
        candidates.where(F.col("distance") <= threshold)
        .join(details, "entry_id")
        .withColumn(
            "score",
            composite_score(similarity_from_distance(F.col("distance")), age, F.col("importance"), half_life_s, weights),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")  # at most 4k rows per query
    return (
        gated.withColumn("position", F.row_number().over(order).cast("bigint"))
        .where(F.col("position") <= k)
        .select("query_id", "entry_id", "distance", "score", "position")
    )


def near_miss_report(candidates: DataFrame, queries: DataFrame, threshold: float = 0.25, factor: float = 2.0) -> DataFrame:
    """Queries without a hit whose nearest memory lies just past the threshold."""
    nearest = candidates.groupBy("query_id").agg(F.min("distance").alias("nearest"))
    return (
        queries.select("query_id")
        .join(nearest, "query_id")
        .where((F.col("nearest") > threshold) & (F.col("nearest") <= threshold * factor))
    )


def reinforce(memories: DataFrame, hits: DataFrame, now_ms: int) -> DataFrame:
    """Recalled items get a new access time and a count per recall; hits on gone items are ignored."""
    touched = hits.groupBy(F.col("entry_id").alias("item_id")).agg(F.count(F.lit(1)).alias("_n"))
    joined = memories.join(touched, "item_id", "left")
    return joined.withColumn(
        "accessed_ms", F.when(F.col("_n").isNotNull(), F.lit(now_ms)).otherwise(F.col("accessed_ms"))
    ).withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def eviction_score(
    now_ms: int, half_life_s: float, weights: tuple[float, float, float] = RECALL_WEIGHTS
) -> Column:
    _, w_recency, w_importance = weights
    age = (F.lit(now_ms) - F.col("accessed_ms")) / 1000
    total = w_importance + w_recency
    if total == 0:
        return F.lit(0.0)
    return (F.lit(w_importance) * F.col("importance") + F.lit(w_recency) * recency_decay(age, half_life_s)) / F.lit(total)


def evictions(
    memories: DataFrame,
    max_items: int,
    now_ms: int,
    half_life_s: float = 604_800.0,
    scope: str = "thread_id",
    weights: tuple[float, float, float] = RECALL_WEIGHTS,
) -> DataFrame:
    """Items to drop so each scope keeps ``max_items``: lowest score first, older access on ties.

    Items outside any scope are never bounded. Positions inside a large scope are counted in
    score slices, so one scope does not sit in one task.
    """
    scoped = memories.where(F.col(scope).isNotNull() & (F.col(scope) != "")).withColumn(
        "score", eviction_score(now_ms, half_life_s, weights)
    )
    slices = F.floor(F.col("score") * 1024)
    counted = with_running_sum(
        scoped, [scope], ["score", "accessed_ms", "item_id"], {"_pos": F.lit(1).cast("bigint")}, slice_by=slices
    )
    sizes = scoped.groupBy(scope).agg((F.count(F.lit(1)) - max(0, max_items)).alias("_drop"))
    return counted.join(sizes, scope).where(F.col("_pos") <= F.col("_drop")).select(scope, "item_id", "score")


def memory_list(memories: DataFrame, limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    """Newest first, with the total of matching items on every row."""
    matching = memories.where(where) if where is not None else memories
    total = matching.agg(F.count(F.lit(1))).scalar()
    return (
        matching.orderBy(F.desc("created_ms"), "item_id")
        .limit(limit + offset)
        .offset(offset)
        .withColumn("total", total)
    )


def memory_stats(memories: DataFrame, evicted: DataFrame) -> DataFrame:
    items = memories.groupBy("thread_id").agg(F.count(F.lit(1)).alias("items"))
    gone = evicted.groupBy("thread_id").agg(F.count(F.lit(1)).alias("evictions"))
    return items.join(gone, "thread_id", "left").withColumn("evictions", F.coalesce("evictions", F.lit(0)))


def forget_by_scope(memories: DataFrame, where: Column | None) -> DataFrame:
    """Memories left after forgetting a scope; at least one criterion is required."""
    if where is None:
        raise ValueError("forgetting needs at least one criterion")
    return memories.where(~F.coalesce(where, F.lit(False)))


def as_of(hits: DataFrame, asked: str = "asked_day", dated: str = "day") -> DataFrame:
    """Hits not dated after the question; all of them where none would remain."""
    kept = F.coalesce(F.col(dated) <= F.col(asked), F.lit(True))
    any_kept = F.max(kept.cast("int")).over(Window.partitionBy("query_id"))  # one small pool per query
    return hits.withColumn("_any", any_kept).where(kept | (F.col("_any") == 0)).drop("_any")


def group_chronologically(hits: DataFrame) -> DataFrame:
    """Reading order of each query's hits: sessions by their first day, then day, then position."""
    pool = Window.partitionBy("query_id", "session_id")
    first_day, first_position = F.min("day").over(pool), F.min("position").over(pool)
    order = Window.partitionBy("query_id").orderBy("_first", "_lead", "day", "position")
    return (
        hits.withColumn("_first", first_day)
        .withColumn("_lead", first_position)
        .withColumn("reading_order", F.row_number().over(order).cast("bigint"))
        .drop("_first", "_lead")
    )


def _contained(a: set, b: set) -> float:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return len(small & large) / len(small) if small else 0.0


def _per_query(hits: DataFrame, text: str, pick, schema_like: Sequence[str]) -> DataFrame:
    """Apply a greedy choice to each query's pool (a few dozen rows), in position order."""
    rows = hits.withColumn("_tokens", token_set_ascii(F.col(text)))
    kinds = dict(hits.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in schema_like) + ", picked bigint"

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("position", kind="stable").reset_index(drop=True)
        chosen = pick([set(t) for t in pool["_tokens"]])
        out = pool.loc[chosen, list(schema_like)].reset_index(drop=True)
        out["picked"] = range(1, len(out) + 1)
        return out

    return rows.groupBy("query_id").applyInPandas(choose, schema)


def dedupe_containment(hits: DataFrame, threshold: float, text: str = "text") -> DataFrame:
    """Keep a hit unless an already kept one contains (or is contained in) it to the threshold."""

    def pick(tokens: list[set]) -> list[int]:
        kept: list[int] = []
        for i, words in enumerate(tokens):
            if not any(_contained(words, tokens[j]) >= threshold for j in kept):
                kept.append(i)
        return kept

    return _per_query(hits, text, pick, [c for c in hits.columns if c != text])


def mmr(hits: DataFrame, k: int, weight: float, text: str = "text") -> DataFrame:
    """Maximal marginal relevance over position relevance and token containment."""

    def pick(tokens: list[set]) -> list[int]:
        left = list(range(len(tokens)))
        chosen: list[int] = []
        while left and len(chosen) < k:
            scored = [
                (weight * (1 - i / len(tokens)) - (1 - weight) * max((_contained(tokens[i], tokens[j]) for j in chosen), default=0.0), -i)
                for i in left
            ]
            best = -max(scored)[1]
            chosen.append(best)
            left.remove(best)
        return chosen

    return _per_query(hits, text, pick, [c for c in hits.columns if c != text])


def _pack(lines: Iterator[str], budget: int) -> Iterator[str]:
    """Join lines greedily while a chunk stays within the word budget; longer lines are sliced."""
    chunk: list[str] = []
    used = 0
    for line in lines:
        words = line.split()
        pieces = [line] if len(words) <= budget else [" ".join(words[i : i + budget]) for i in range(0, len(words), budget)]
        for piece in pieces:
            size = len(piece.split())
            if chunk and used + size > budget:
                yield "\n".join(chunk)
                chunk, used = [], 0
            chunk.append(piece)
            used += size
    if chunk:
        yield "\n".join(chunk)


def chunk_sessions(turns: DataFrame, budget: int) -> DataFrame:
    """Sessions packed into chunks of whole turns. (session_id, turn, line) to (session_id, part, text).

    Turns stream through in order, so a session is never held whole; the session id stays on every chunk.
    """
    ordered = turns.select("session_id", "turn", "line").repartition("session_id").sortWithinPartitions("session_id", "turn")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, l) for batch in batches for s, l in zip(batch["session_id"], batch["line"]))
        from itertools import groupby

        out: list[tuple] = []
        for session, lines in groupby(rows, key=lambda r: r[0]):
            for part, text in enumerate(_pack((line for _, line in lines), budget)):
                out.append((session, part, text))
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["session_id", "part", "text"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["session_id", "part", "text"])

    return ordered.mapInPandas(pack, f"session_id {dict(turns.dtypes)['session_id']}, part bigint, text string")


def chunk_turns(turns: DataFrame, budget: int) -> DataFrame:
    """One chunk per turn; turns over the budget are sliced into word runs."""
    words = F.split(F.trim("line"), r"\s+")
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(budget))
    parts = F.when(n <= budget, F.array(F.col("line"))).otherwise(
        F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(budget)), " "))
    )
    return turns.select("session_id", "turn", F.posexplode(parts).alias("part", "text")).withColumn(
        "part", F.col("part").cast("bigint")
    )


def subject_key(subject: Column) -> Column:
    return F.lower(F.trim(subject))


def consolidation_candidates(
    memories: DataFrame, now_ms: int, older_than_ms: int, max_importance: float, where: Column | None = None, own_source: str = "consolidated"
) -> DataFrame:
    """Memories to fold together: in scope, old and unimportant enough, not consolidated output themselves."""
    out = memories.where(
        (F.col("created_ms") <= now_ms - older_than_ms)
        & (F.col("importance") <= max_importance)
        & (F.coalesce("source", F.lit("")) != own_source)
    )
    return out.where(where) if where is not None else out


def consolidation_plan(stored: DataFrame, curated: DataFrame, keys: Sequence[str] = ("scope", "subject")) -> DataFrame:
    """Rows to create, rewrite or delete so that the stored facts equal the curated ones.

    Several stored rows of one subject are healed: the smallest id is kept, the others deleted.
    ``stored`` has (id, keys, statement); ``curated`` (keys, statement).
    """
    keys = list(keys)
    folded = lambda df: df.withColumn("subject", subject_key(F.col("subject")))
    heads = folded(stored).groupBy(*keys).agg(
        F.min_by("statement", "id").alias("_stored"), F.min("id").alias("id")
    )
    joined = heads.join(folded(curated), keys, "full")
    action = (
        F.when(F.col("id").isNull(), "create")
        .when(F.col("statement").isNull(), "delete")
        .when(F.col("statement") != F.col("_stored"), "rewrite")
    )
    main = joined.withColumn("action", action).where(F.col("action").isNotNull()).select("action", *keys, "id", "statement")
    doubles = (
        folded(stored)
        .join(heads.select(*keys, F.col("id").alias("_kept")), keys)
        .where(F.col("id") != F.col("_kept"))
        .select(F.lit("delete").alias("action"), *keys, "id", F.lit(None).cast("string").alias("statement"))
    )
    return main.unionByName(doubles)
