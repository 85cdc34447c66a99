"""Latency profiles, trends, histograms and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.keys import latency_bucket
from fleetscope.operators.quantiles import Quantile, exact_quantiles
from fleetscope.operators.scopes import first_rows, scoped
from fleetscope.operators.series import HOUR_MS, with_last_known

PROFILE = [Quantile("p50", "nearest", 0.5), Quantile("p95", "nearest", 0.95), Quantile("p99", "nearest", 0.99)]
SEARCH = "FT.SEARCH:"
# Fixed value: healthy median of a vector search, microseconds.
SEARCH_P50_LIMIT_US = 10_000


def latency_entries(log: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Timed entries of ``[start, end)`` that fall into a latency bucket."""
    return (
        log.where((F.col("log_type") == "slow") & (F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
        .withColumn("bucket", latency_bucket(F.col("args")[0], F.get(F.col("args"), F.lit(1))))
        .where(F.col("bucket").isNotNull())
    )


def latency_profile(
    log: DataFrame, start_ms: int, end_ms: int, limit_us: int = SEARCH_P50_LIMIT_US
) -> DataFrame:
    entries = latency_entries(log, start_ms, end_ms)
    profile = exact_quantiles(entries, ["connection_id", "bucket"], "value", PROFILE)
    return profile.withColumn("unhealthy", F.col("bucket").startswith(SEARCH) & (F.col("p50") > limit_us))


def latency_profile_sketch(log: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Approximate profile from mergeable quantile sketches of bounded size."""
    entries = latency_entries(log, start_ms, end_ms)
    sketches = entries.groupBy("connection_id", "bucket").agg(
        F.kll_sketch_agg_bigint("value").alias("sk"), F.count(F.lit(1)).alias("n")
    )
    quantile = lambda p: F.kll_sketch_get_quantile_bigint("sk", F.lit(p))
    return sketches.select(
        "connection_id", "bucket", "n", quantile(0.5).alias("p50"), quantile(0.95).alias("p95")
    )


def latency_trend(
    log: DataFrame, start_ms: int, end_ms: int, bin_ms: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Profile per bin counted from the window start; empty bins are absent."""
    binned = latency_entries(scoped(log, keys), start_ms, end_ms).withColumn(
        "bin_ms", F.lit(start_ms) + F.floor((F.col("ts_ms") - start_ms) / bin_ms) * bin_ms
    )
    return exact_quantiles(binned, [*keys, "bucket", "bin_ms"], "value", PROFILE)


def histogram_percentiles(histogram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First bucket whose cumulative count reaches the share; ``histogram`` has (command, bucket, n) and the keys."""
    by = [*keys, "command"]
    per = scoped(histogram, keys).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    # A histogram has at most 64 power-of-two buckets per command.
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = per.withColumn("_cum", F.sum("n").over(upto)).withColumn("_total", F.sum("n").over(whole))

    def at(percent: int):
        reached = F.col("_cum") >= F.col("_total") * F.lit(percent / 100.0)
        return F.min(F.when(reached, F.col("bucket")))

    return cumulative.groupBy(*by).agg(
        F.max("_total").alias("calls"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99")
    )


def histogram_top_commands(histogram: DataFrame, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Busiest commands, without the server's own latency and config commands."""
    own = F.col("command").startswith("latency|") | F.col("command").startswith("config|")
    per = scoped(histogram, keys).where(~own).groupBy(*keys, "command").agg(F.sum("n").alias("calls"))
    return first_rows(per, keys, [F.desc("calls"), "command"], k)


def latest_latency_events(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Newest entry per event name; ``events`` has (event, ts_ms, id, value)."""
    order = F.struct("ts_ms", "id")
    return scoped(events, keys).groupBy(*keys, "event").agg(
        F.max("ts_ms").alias("ts_ms"),
        F.max_by("value", order).alias("latest_value"),
        F.max("value").alias("max_value"),
    )


def annotate_indexing(
    log: DataFrame, snapshots: DataFrame, start_ms: int, end_ms: int, tail: float = 0.1
) -> DataFrame:
    """Search buckets whose slowest tenth ran while their index was still being built.

    ``snapshots`` has (connection_id, index_name, ts_ms, percent_indexed). The newest
    snapshot at or before each search is found by carrying it over the union of both series.
    """
    keys = ["connection_id", "bucket"]
    searches = latency_entries(log, start_ms, end_ms).where(F.col("bucket").startswith(SEARCH))
    cuts = exact_quantiles(searches, keys, "value", [Quantile("cut", "floor", 1 - tail)])
    slow = searches.join(cuts, keys).where(F.col("value") >= F.col("cut"))
    union = slow.select(
        *keys, "ts_ms", F.lit(1).alias("kind"), F.lit(None).cast("struct<ts:bigint,pct:double>").alias("snap")
    ).unionByName(
        snapshots.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms)).select(
            "connection_id",
            F.concat(F.lit(SEARCH), "index_name").alias("bucket"),
            "ts_ms",
            F.lit(0).alias("kind"),
            F.struct(F.col("ts_ms").alias("ts"), F.col("percent_indexed").alias("pct")).alias("snap"),
        )
    )
    carried = with_last_known(union, keys, ["ts_ms", "kind"], {"at": "snap"}, HOUR_MS * 24)
    return (
        carried.where((F.col("kind") == 1) & (F.col("at.pct") < 100))
        .groupBy(*keys)
        .agg(F.min("at.ts").alias("since_ms"), F.count(F.lit(1)).alias("affected"))
    )


def trace_summary(
    spans: DataFrame,
    tracked_scopes: list[str],
    start_ms: int | None = None,
    end_ms: int | None = None,
    service: str | None = None,
) -> DataFrame:
    """One row per trace; filters keep or drop whole traces."""
    root = F.col("parent_id").isNull()
    out = spans.groupBy("trace_id").agg(
        F.min("start_ms").alias("start_ms"),
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("scope").isin(tracked_scopes)).alias("tracked_spans"),
        F.bool_or(F.col("status") == 2).alias("has_error"),
        F.max(F.when(root, F.col("scope"))).alias("root_name"),
        F.coalesce(F.max(F.when(root, F.col("service"))), F.max("service")).alias("service"),
        F.coalesce(
            F.max(F.when(root, F.col("duration_ns"))),
            (F.max(F.col("start_ms") + F.floor(F.col("duration_ns") / 1_000_000)) - F.min("start_ms")) * 1_000_000,
        ).alias("duration_ns"),
        F.count_if(F.col("service") == (service or "")).alias("_svc"),
    )
    if start_ms is not None:
        out = out.where(F.col("start_ms") >= start_ms)
    if end_ms is not None:
        out = out.where(F.col("start_ms") <= end_ms)
    if service is not None:
        out = out.where(F.col("_svc") > 0)
    return out.drop("_svc")
