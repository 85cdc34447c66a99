"""Structured Streaming jobs around the folds: sources, deduplication, late rows, idempotent sinks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetscope.session import checkpoint_root
from fleetscope.sources import schemas
from fleetscope.streaming import folds
from fleetscope.streaming.detectors import SpikeConfig
from fleetscope.streaming.runner import fold_stream


def metric_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Metric files as a stream; the bound keeps one micro-batch, and so one key of it, small."""
    return (
        spark.readStream.schema(schemas.METRIC).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def baseline_then_spike(config: SpikeConfig, rows: int = 300, ready: int = 30):
    """Stream form of the spike detector: the last rows live in the state as exact integer units."""
    fire = folds.spike(config.consecutive, config.cooldown_ms)

    class Rated:
        __slots__ = ("ts_ms", "id", "severity", "z", "value")

        def __init__(self, row, severity, z):
            self.ts_ms, self.id, self.value = row.ts_ms, row.id, row.value
            self.severity, self.z = severity, z

    def step(state, row):
        cents = round(row.value * 100)
        held = (state.get("cents", []) + [cents])[-rows:]
        state["cents"] = held
        n, s, q = len(held), sum(held), sum(c * c for c in held)
        if n < ready:
            return
        spread = math.sqrt(n * q - s * s) / n
        z = 0.0 if spread == 0 else (cents - s / n) / spread
        if z < 0 and not config.detect_drops:
            return
        over = lambda limit: limit is not None and row.value >= limit
        severity = "critical" if abs(z) >= config.critical_z else "warning" if abs(z) >= config.warning_z else None
        if over(config.critical_value):
            severity = "critical"
        elif severity is None and over(config.warning_value):
            severity = "warning"
        yield from fire(state, Rated(row, severity, z))

    return step


def spike_stream(metrics: DataFrame, config: SpikeConfig) -> DataFrame:
    """Alerts of a metric stream (connection_id, metric, ts_ms, id, value)."""
    return fold_stream(
        metrics, ["connection_id", "metric"], ["ts_ms", "id"], baseline_then_spike(config),
        "ts_ms bigint, id bigint, severity string, anomaly_type string, value double",
    )


def anchor_stream(events: DataFrame, window_ms: int = 5_000) -> DataFrame:
    """Events of a stream with the start of their first-anchored window."""
    return fold_stream(
        events.select("connection_id", "ts_ms", "id"), ["connection_id"], ["ts_ms", "id"], folds.anchored_window(window_ms),
        "ts_ms bigint, id bigint, start_ms bigint, head_id bigint",
    )


def dedupe_spans(spans: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """First copy of each (trace, span) within the watermark."""
    timed = spans.withColumn("event_time", F.timestamp_millis("start_ms")).withWatermark("event_time", lateness)
    return timed.dropDuplicatesWithinWatermark(["trace_id", "span_id"]).drop("event_time")


def split_late(rows: DataFrame, allowed_ms: int, event: str = "ts_ms", arrival: str = "captured_ms") -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that arrived later than allowed (for a side table).

    A row without either time counts as in time.
    """
    late = F.coalesce(F.col(arrival) - F.col(event) > allowed_ms, F.lit(False))
    return rows.where(~late), rows.where(late)


def write_batches(stream: DataFrame, path: str, checkpoint: str | None = None, mode: str = "append") -> StreamingQuery:
    """Each micro-batch overwrites its own folder, so a repeated batch leaves one copy.

    Runs over what is there and stops; start again with the same checkpoint to go on.
    """
    spark = stream.sparkSession
    where = checkpoint or f"{checkpoint_root(spark)}/{path.strip('/').replace('/', '_')}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", where)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def late_and_in_time(stream: DataFrame, path: str, allowed_ms: int, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Write rows in time and late rows of a stream to two tables in one pass."""

    def write(batch: DataFrame, batch_id: int) -> None:
        in_time, late = split_late(batch, allowed_ms)
        in_time.dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{path}/in_time/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    )
