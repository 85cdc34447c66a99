"""Analytics over captured slow and large command logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.identity import client_identity
from fleetscope.functions.keys import key_prefix, log_key_pattern, sanitize_args, scan_command
from fleetscope.operators.scopes import first_rows, scoped, with_totals

# Scan-reply skew limits.
SCAN_BYTES_PER_ELEMENT = 4096
SCAN_MIN_KEYED_REPLY_BYTES = 262_144
SCAN_MIN_SIGHTINGS = 2
SCAN_EXTREME_MULTIPLIER = 10


def log_scan(
    log: DataFrame,
    start_ms: int | None = None,
    end_ms: int | None = None,
    command: str | None = None,
    client: str | None = None,
    log_type: str | None = None,
    min_value: int | None = None,
    sort_by: str = "recent",
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Filtered entries, newest or largest first; every predicate reaches the scan."""
    out = log
    if start_ms is not None:
        out = out.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        out = out.where(F.col("ts_ms") <= end_ms)
    if command is not None:
        out = out.where(F.upper("verb").contains(command.upper()))
    if client is not None:
        out = out.where(F.lower("client_name").contains(client.lower()))
    if log_type is not None:
        out = out.where(F.col("log_type") == log_type)
    if min_value is not None:
        out = out.where(F.col("value") >= min_value)
    if limit is None and not offset:
        return out
    first = F.desc("ts_ms") if sort_by == "recent" else F.desc("value")
    ordered = out.orderBy(first, F.desc("id"))
    return ordered.limit(limit + offset).offset(offset) if limit is not None else ordered.offset(offset)


def with_log_pattern(log: DataFrame) -> DataFrame:
    """Adds command, key pattern, combined pattern, prefix and client identity."""
    has_key = F.col("key").isNotNull() & (F.col("key") != "")
    return (
        log.withColumn("command", F.upper("verb"))
        .withColumn("key_pattern", F.when(has_key, log_key_pattern(F.col("key"))).otherwise("(no key)"))
        .withColumn("pattern", F.concat_ws(" ", "command", "key_pattern"))
        .withColumn("prefix", key_prefix(F.col("command"), F.col("key")))
        .withColumn("client", client_identity(F.col("client_name"), F.col("client_addr")))
    )


def _value_stats(grouped) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total_value"),
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
    )


def log_patterns(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per pattern: count, share of its scope, and sum/avg/min/max of the value."""
    entries = with_log_pattern(scoped(log, keys))
    stats = _value_stats(entries.groupBy(*keys, "pattern", "command", "key_pattern"))
    return (
        with_totals(stats, keys, _all=F.sum("n"))
        .withColumn("pct", F.col("n") / F.col("_all") * 100)
        .withColumn("avg_value", F.col("total_value") / F.col("n"))
        .drop("_all")
    )


def log_breakdown(log: DataFrame, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, share of all entries of the scope and mean value per command, prefix or client."""
    entries = with_log_pattern(scoped(log, keys))
    per = entries.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("_s"))
    return (
        with_totals(per, keys, _all=F.sum("n"))
        .withColumn("pct", F.col("n") / F.col("_all") * 100)
        .withColumn("avg_value", F.col("_s") / F.col("n"))
        .where(F.col(by).isNotNull())
        .drop("_s", "_all")
    )


def pattern_clients(log: DataFrame, top: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Most active clients of every pattern with their share of it."""
    by = [*keys, "pattern"]
    per = (
        with_log_pattern(scoped(log, keys))
        .groupBy(*by, "client")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("_s"), F.max("value").alias("max_value"))
    )
    totals = per.groupBy(*by).agg(F.sum("n").alias("_pattern_n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "client"))
    return (
        per.withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= top)
        .join(totals, by)
        .withColumn("pct", F.col("n") / F.col("_pattern_n") * 100)
        .withColumn("avg_value", F.col("_s") / F.col("n"))
        .drop("_s", "_pattern_n")
    )


def pattern_examples(log: DataFrame, top: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """First entries of every pattern, with unsafe argument values masked."""
    rank = F.row_number().over(Window.partitionBy(*keys, "pattern").orderBy("ts_ms", "id"))
    # row_number with a bound is limited per partition before the shuffle
    return (
        with_log_pattern(scoped(log, keys))
        .withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= top)
        .select(
            *keys,
            "pattern",
            "rank",
            "id",
            "ts_ms",
            "value",
            "client_addr",
            F.concat_ws(" ", sanitize_args(F.col("args"))).alias("full_command"),
        )
    )


def top_commands(log: DataFrame, k: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """Busiest commands of the scope; equal counts by name."""
    per = scoped(log, keys).groupBy(*keys, F.upper("verb").alias("command")).agg(F.count(F.lit(1)).alias("n"))
    return first_rows(per, keys, [F.desc("n"), "command"], k)


def top_commands_sketch(log: DataFrame, k: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """Approximate heavy hitters in bounded memory per scope."""
    top = scoped(log, keys).groupBy(*keys).agg(F.expr(f"approx_top_k(upper(verb), {k})").alias("t"))
    return top.select(*keys, F.explode("t").alias("t")).select(
        *keys, F.col("t.item").alias("command"), F.col("t.count").cast("bigint").alias("n")
    )


def scan_skew(log: DataFrame) -> DataFrame:
    """Scan replies whose size is out of proportion to the requested COUNT."""
    budget = SCAN_BYTES_PER_ELEMENT
    scans = (
        log.where(F.col("log_type") == "large-reply")
        .withColumn("scan", scan_command(F.col("args")))
        .where(F.col("scan").isNotNull())
        .where(F.col("scan.key").isNull() | (F.col("value") >= SCAN_MIN_KEYED_REPLY_BYTES))
        .withColumn("per_element", F.col("value") / F.col("scan.count"))
        .where(F.col("per_element") >= budget)
    )
    subject = F.coalesce(
        F.col("scan.key"), F.concat(F.lit("SCAN "), F.coalesce(F.col("scan.match"), F.lit("*")))
    )
    return (
        scans.groupBy("connection_id", subject.alias("subject"))
        .agg(
            F.min_by("scan.verb", F.struct("ts_ms", "id")).alias("verb"),
            F.count(F.lit(1)).alias("sightings"),
            F.max("per_element").alias("_worst"),
            F.sum("value").alias("total_bytes"),
            F.max("ts_ms").alias("last_ms"),
        )
        .where(
            (F.col("sightings") >= SCAN_MIN_SIGHTINGS)
            | (F.col("_worst") >= budget * SCAN_EXTREME_MULTIPLIER)
        )
        .withColumn("worst_per_element", F.floor(F.col("_worst") + 0.5))
        .drop("_worst")
    )


def large_reply_pressure(
    log: DataFrame, threshold: int, min_crossings: int = 5, keys: Sequence[str] = ("connection_id",)
) -> DataFrame:
    """Commands whose replies keep crossing the large-reply limit."""
    return (
        log.where((F.col("log_type") == "large-reply") & (F.col("value") >= threshold))
        .groupBy(*keys, F.upper("verb").alias("command"))
        .agg(
            F.count(F.lit(1)).alias("crossings"),
            F.max("value").alias("worst_bytes"),
            F.avg("value").alias("avg_bytes"),
            F.sum("value").alias("total_bytes"),
            F.max("ts_ms").alias("last_ms"),
        )
        .where(F.col("crossings") >= min_crossings)
    )


def cluster_log(log: DataFrame, node: str | Column, limit: int) -> DataFrame:
    """Newest entries over all nodes, each tagged with its node."""
    tagged = log.withColumn("node", F.col(node) if isinstance(node, str) else node)
    return tagged.orderBy(F.desc("ts_ms"), F.desc("id")).limit(limit)
