"""Idempotent writes and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the newest: insert-or-replace. Combined before the shuffle."""
    return _keep(rows, keys, order, F.max_by)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the oldest: insert-or-ignore."""
    return _keep(rows, keys, order, F.min_by)


def _keep(rows: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    chosen = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return chosen.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stored rows with newer incoming rows put in; on equal order the incoming row wins."""
    both = stored.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    return keep_last(both, keys, [*order, "_in"]).drop("_in")


def write_partitioned(rows: DataFrame, path: str, ts: str = "ts_ms", mode: str = "append") -> None:
    """Parquet by connection and day; rows of one partition are spread over several writers."""
    day = F.to_date(F.timestamp_millis(F.col(ts)))
    rows.withColumn("day", day).repartition("connection_id", "day", F.pmod(F.xxhash64(ts), F.lit(16))).write.mode(
        mode
    ).partitionBy("connection_id", "day").parquet(path)


def retain(rows: DataFrame, cutoff_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Rows at or after the cutoff."""
    return rows.where(F.col(ts) >= cutoff_ms)


def retain_traces(spans: DataFrame, cutoff_ms: int) -> DataFrame:
    """Spans of traces that start at or after the cutoff; a trace is kept or dropped whole."""
    old = spans.groupBy("trace_id").agg(F.min("start_ms").alias("_s")).where(F.col("_s") < cutoff_ms)
    return spans.join(old, "trace_id", "left_anti")


def merge_stored_and_live(stored: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Union of stored and not yet stored events; on the same id the stored one wins."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    return keep_first(both, [key], ["_p"]).drop("_p")


def page(rows: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).limit(limit + offset).offset(offset)
