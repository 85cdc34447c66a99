"""Keyspace samples: patterns, rankings, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.keys import glob_regex, keyspace_pattern


def js_round(value: Column) -> Column:
    """Halves up, as a whole number."""
    return F.floor(value + F.lit(0.5))


def key_pattern_snapshot(keys: DataFrame, databases: DataFrame) -> DataFrame:
    """Per (connection, pattern) estimates scaled from the scanned keys to the whole database.

    Keys are first reduced per access-frequency value (an eight-bit counter), so comparing with
    the pattern's mean frequency runs over at most a few hundred rows per pattern and not over keys.
    ``databases`` has (connection_id, scanned, db_size).
    """
    has_ttl = F.col("ttl_s") > 0
    reduced = (
        keys.withColumn("pattern", keyspace_pattern(F.col("key")))
        .groupBy("connection_id", "pattern", "freq")
        .agg(
            F.count(F.lit(1)).alias("c"),
            F.sum("memory_bytes").alias("mem"),
            F.max("memory_bytes").alias("mem_max"),
            F.sum("idle_s").alias("idle"),
            F.count_if(has_ttl).alias("ttl_n"),
            F.sum(F.when(has_ttl, F.col("ttl_s"))).alias("ttl_sum"),
            F.min(F.when(has_ttl, F.col("ttl_s"))).alias("ttl_min"),
            F.max(F.when(has_ttl, F.col("ttl_s"))).alias("ttl_max"),
            F.count_if(has_ttl & (F.col("ttl_s") < 3600)).alias("soon"),
        )
    )
    whole = Window.partitionBy("connection_id", "pattern")
    freq_n = F.sum(F.when(F.col("freq").isNotNull(), F.col("c"))).over(whole)
    joined = reduced.withColumn("avg_freq", F.sum(F.col("freq") * F.col("c")).over(whole) / freq_n)
    stats = joined.groupBy("connection_id", "pattern").agg(
        F.sum("c").alias("sampled"),
        F.sum("mem").alias("mem"),
        F.max("mem_max").alias("max_memory"),
        F.sum("idle").alias("idle"),
        F.sum("ttl_n").alias("ttl_n"),
        F.sum("ttl_sum").alias("ttl_sum"),
        F.min("ttl_min").alias("min_ttl"),
        F.max("ttl_max").alias("max_ttl"),
        F.sum("soon").alias("soon"),
        F.max("avg_freq").alias("avg_freq"),
        F.sum(F.when(F.col("freq") > F.col("avg_freq"), F.col("c")).otherwise(0)).alias("hot_n"),
        F.sum(F.when(F.col("freq") < F.col("avg_freq") / 2, F.col("c")).otherwise(0)).alias("cold_n"),
    )
    ratio = F.col("scanned") / F.col("db_size")
    avg_idle = js_round(F.col("idle") / F.col("sampled"))
    return stats.join(databases, "connection_id").select(
        "connection_id",
        "pattern",
        js_round(F.col("sampled") / ratio).alias("key_count"),
        F.col("sampled"),
        js_round(F.col("ttl_n") / ratio).alias("keys_with_ttl"),
        js_round(F.col("soon") / ratio).alias("keys_expiring_soon"),
        js_round(F.col("mem") / ratio).alias("total_memory"),
        js_round(F.col("mem") / F.col("sampled")).alias("avg_memory"),
        "max_memory",
        "avg_freq",
        F.when(F.col("avg_freq").isNotNull(), F.col("hot_n")).alias("hot_keys"),
        F.when(F.col("avg_freq").isNotNull(), F.col("cold_n")).alias("cold_keys"),
        avg_idle.alias("avg_idle_s"),
        F.when(avg_idle > 86400, js_round(avg_idle / F.lit(86400.0) * F.col("sampled")))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("stale_keys"),
        js_round(F.col("ttl_sum") / F.col("ttl_n")).alias("avg_ttl_s"),
        "min_ttl",
        "max_ttl",
    )


def key_summary(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot of every (connection, pattern), and their sum per connection.

    ``snapshots`` has (connection_id, pattern, ts_ms, id, key_count, memory, stale).
    """
    latest = snapshots.groupBy("connection_id", "pattern").agg(
        F.max_by(F.struct("key_count", "memory", "stale"), F.struct("ts_ms", "id")).alias("s")
    )
    flat = latest.select("connection_id", "pattern", "s.*")
    rolled = flat.groupingSets(
        [("connection_id", "pattern"), ("connection_id",)], "connection_id", "pattern"
    ).agg(
        F.sum("key_count").alias("key_count"),
        F.sum("memory").alias("memory"),
        F.sum("stale").alias("stale"),
        F.count(F.lit(1)).alias("patterns"),
    )
    return rolled.withColumn("pattern", F.coalesce("pattern", F.lit("(all)")))


def ttl_distribution(keys: DataFrame) -> DataFrame:
    ttl = F.col("ttl_s")
    return keys.groupBy("connection_id").agg(
        F.count_if(ttl == -1).alias("no_expiry"),
        F.count_if((ttl >= 0) & (ttl < 3600)).alias("within_1h"),
        F.count_if((ttl >= 3600) & (ttl < 86400)).alias("within_24h"),
        F.count_if((ttl >= 86400) & (ttl < 604800)).alias("within_7d"),
        F.count_if(ttl >= 604800).alias("later"),
    )


def key_count_comparison(source: DataFrame, target: DataFrame) -> DataFrame:
    """Key totals of a migration's two sides per connection."""
    left = source.groupBy("connection_id").agg(F.count(F.lit(1)).alias("s"))
    right = target.groupBy("connection_id").agg(F.count(F.lit(1)).alias("t"))
    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    pct = F.when(s == 0, F.when(t > 0, 100.0).otherwise(0.0)).otherwise(F.abs((t - s) / s) * 100)
    return left.join(right, "connection_id", "full").select(
        "connection_id",
        s.alias("source_keys"),
        t.alias("target_keys"),
        (t - s).alias("discrepancy"),
        (js_round(pct * 100) / 100).alias("discrepancy_pct"),
        ((s == 0) & (t > 0)).alias("stale_target"),
    )


def type_estimates(source: DataFrame, totals: DataFrame) -> DataFrame:
    """Expected keys per type on the target, by the ratio of totals."""
    types = source.groupBy("connection_id", "key_type").agg(F.count(F.lit(1)).alias("source_estimate"))
    ratio = F.col("target_keys") / F.col("source_keys")
    return types.join(totals.where(F.col("source_keys") > 0), "connection_id").select(
        "connection_id",
        "key_type",
        "source_estimate",
        js_round(F.col("source_estimate") * ratio).alias("target_estimate"),
    )


def field_expiry_estimate(sampled: DataFrame, hash_totals: DataFrame, max_fields: int | None = None) -> DataFrame:
    """Hashes with per-field expiry, extrapolated from the sampled ones.

    ``sampled`` has (connection_id, fields, has_field_ttl); ``hash_totals`` (connection_id, total_hashes).
    Hashes of any size count unless ``max_fields`` is given; those over it are left out of both
    sides of the share.
    """
    fits = F.lit(True) if max_fields is None else F.col("fields") <= max_fields
    per = sampled.groupBy("connection_id").agg(
        F.count_if(fits).alias("sampled_hashes"),
        F.count_if(~fits).alias("oversized_skipped"),
        F.count_if(fits & F.col("has_field_ttl")).alias("positive"),
    )
    return per.join(hash_totals, "connection_id").select(
        "connection_id",
        "sampled_hashes",
        "oversized_skipped",
        (F.col("positive") > 0).alias("detected"),
        js_round(
            F.when(F.col("sampled_hashes") > 0, F.col("positive") / F.col("sampled_hashes")).otherwise(0.0) * F.col("total_hashes")
        ).alias("estimated_keys"),
    )


def hot_keys(keys: DataFrame, k: int = 50) -> DataFrame:
    """Keys with an access-frequency signal rank above those with only an idle time."""
    lfu = F.col("freq").isNotNull()
    order = (F.when(lfu, 0).otherwise(1), F.desc("freq"), F.col("idle_s"), F.col("key"))
    rank = F.row_number().over(Window.partitionBy("connection_id").orderBy(*order))
    return keys.where(lfu | F.col("idle_s").isNotNull()).withColumn("rank", rank.cast("bigint")).where(
        F.col("rank") <= k
    ).select(
        "connection_id",
        "rank",
        "key",
        F.when(lfu, "lfu").otherwise("idletime").alias("signal"),
        "freq",
        F.when(~lfu, F.col("idle_s")).alias("idle_s"),
        "memory_bytes",
    )


def largest_keys(keys: DataFrame, k: int = 50) -> DataFrame:
    rank = F.row_number().over(
        Window.partitionBy("connection_id").orderBy(F.desc("cardinality"), "key")
    )
    return (
        keys.where(F.col("cardinality").isNotNull())
        .withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= k)
        .select("connection_id", "rank", "key", "key_type", "cardinality", "memory_bytes")
    )


def largest_by_memory(ranked: DataFrame, k: int = 50) -> DataFrame:
    """Re-rank stored rows by memory, one row per key with its largest memory."""
    per_key = ranked.groupBy("connection_id", "key").agg(F.max("memory_bytes").alias("memory_bytes"))
    rank = F.row_number().over(
        Window.partitionBy("connection_id").orderBy(F.desc("memory_bytes"), "key")
    )
    return per_key.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def composite_keys(keys: DataFrame, k: int) -> DataFrame:
    """Keys in the top ``k`` of both hotness and cardinality, with summed normalised scores.

    A frequency of zero is cold and places nowhere; idle time only stands in for a missing frequency.
    """
    hotness = F.when(F.col("freq").isNotNull(), F.col("freq").cast("double")).when(
        F.col("idle_s") >= 0, F.lit(1.0) / (1 + F.col("idle_s"))
    )

    def top(value: Column, name: str) -> DataFrame:
        per = keys.select("connection_id", "key", value.cast("double").alias(name)).where(F.col(name) > 0)
        rank = F.row_number().over(Window.partitionBy("connection_id").orderBy(F.desc(name), "key"))
        best = per.withColumn("_rn", rank).where(F.col("_rn") <= k)
        peak = F.max(name).over(Window.partitionBy("connection_id"))  # over at most k rows
        return best.withColumn(f"{name}_max", peak).drop("_rn")

    return top(hotness, "hotness").join(top(F.col("cardinality"), "size"), ["connection_id", "key"]).select(
        "connection_id",
        "key",
        "hotness",
        "size",
        (F.col("hotness") / F.col("hotness_max") + F.col("size") / F.col("size_max")).alias("score"),
    )


def rank_movement(ranks: DataFrame) -> DataFrame:
    """Latest rank of each key against its rank in the earliest snapshot of the connection.

    ``ranks`` has (connection_id, captured_ms, key, rank).
    """
    ends = ranks.groupBy("connection_id").agg(
        F.min("captured_ms").alias("first_ms"), F.max("captured_ms").alias("last_ms")
    )
    marked = ranks.join(ends, "connection_id")
    first = marked.where(F.col("captured_ms") == F.col("first_ms")).select(
        "connection_id", "key", F.col("rank").alias("first_rank")
    )
    last = marked.where(F.col("captured_ms") == F.col("last_ms")).select("connection_id", "key", "rank")
    return last.join(first, ["connection_id", "key"], "left").select(
        "connection_id",
        "key",
        "rank",
        (F.col("first_rank") - F.col("rank")).alias("moved_up"),
        F.when(F.col("first_rank").isNull(), "new")
        .when(F.col("first_rank") > F.col("rank"), "up")
        .when(F.col("first_rank") < F.col("rank"), "down")
        .otherwise("same")
        .alias("movement"),
    )


def _catch_all(glob: str) -> bool:
    return bool(glob) and set(glob) <= {"*"}


def pattern_delete_preview(
    keys: DataFrame,
    glob: str,
    key_type: str | None = None,
    max_keys: int | None = 10_000,
    confirm_all: bool = False,
) -> DataFrame:
    """Keys a bulk delete would remove, per node; empty and unconfirmed catch-all patterns are refused."""
    glob = glob.strip()
    if not glob:
        raise ValueError("a non-empty match pattern is required")
    if _catch_all(glob) and not confirm_all:
        raise ValueError("a catch-all pattern needs confirm_all")
    matched = matching_keys(keys, glob, key_type)
    capped = F.lit(max_keys).cast("bigint")
    return matched.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("matched"),
        F.sum("memory_bytes").alias("memory_bytes"),
        F.min("key").alias("first_key"),
    ).withColumn("truncated", F.coalesce(F.col("matched") > capped, F.lit(False)))


def matching_keys(keys: DataFrame, glob: str, key_type: str | None = None) -> DataFrame:
    out = keys.where(F.col("key").rlike(_glob_literal(glob)))
    return out.where(F.col("key_type") == key_type) if key_type else out


def delete_matching(keys: DataFrame, glob: str, key_type: str | None = None, confirm_all: bool = False) -> DataFrame:
    """The table without the matching keys."""
    if not glob.strip() or (_catch_all(glob.strip()) and not confirm_all):
        raise ValueError("refusing an empty or unconfirmed catch-all pattern")
    drop = F.col("key").rlike(_glob_literal(glob.strip()))
    if key_type:
        drop = drop & (F.col("key_type") == key_type)
    return keys.where(~F.coalesce(drop, F.lit(False)))


def _glob_literal(glob: str) -> str:
    import re

    parts = [".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob]
    return "(?s)^" + "".join(parts) + "$"


def slot_summary(slots: DataFrame) -> DataFrame:
    """``slots`` has (slot, key_count)."""
    return slots.agg(
        F.sum("key_count").alias("total_keys"),
        F.count_if(F.col("key_count") > 0).alias("populated"),
        (F.sum("key_count") / F.greatest(F.count_if(F.col("key_count") > 0), F.lit(1))).alias("avg_keys"),
    )


def slot_intensity(slots: DataFrame) -> DataFrame:
    peak = slots.agg(F.greatest(F.max("key_count"), F.lit(1).cast("bigint"))).scalar()
    return slots.where(F.col("key_count") > 0).select(
        "slot", "key_count", (F.lit(0.1) + F.col("key_count") / peak * F.lit(0.9)).alias("intensity")
    )


def field_distribution(docs: DataFrame, column: str, kind: str, top: int = 50) -> DataFrame:
    """Top values of a tag (comma separated) or text field, or statistics of a numeric one."""
    value = F.col(column)
    if kind == "NUMERIC":
        number = value.try_cast("double")
        return docs.agg(
            F.min(number).alias("min_value"),
            F.max(number).alias("max_value"),
            F.avg(number).alias("avg_value"),
            F.count(number).alias("n"),
        )
    if kind == "TAG":
        rows = docs.select(F.explode(F.split(value, ",")).alias("value")).withColumn("value", F.trim("value"))
    else:
        rows = docs.select(value.alias("value"))
    counted = (
        rows.where(F.col("value") != "")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(top)
    )
    if kind == "TAG":
        return counted
    label = F.when(F.length("value") > 60, F.concat(F.substring("value", 1, 57), F.lit("..."))).otherwise(F.col("value"))
    return counted.withColumn("value", label)


def glob_matches(value: Column, glob: Column) -> Column:
    """Column-by-column glob match."""
    return F.regexp_like(value, glob_regex(glob))
