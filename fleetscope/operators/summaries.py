"""One-pass summaries over several dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_dimensions(
    df: DataFrame,
    dimensions: Sequence[str],
    aggregates: Mapping[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Totals plus one group per value of each dimension, long form (``dim``, ``label``).

    A single grouping-sets aggregation replaces one query per dimension.
    """
    base = list(keys)
    sets = [tuple(base)] + [tuple([*base, d]) for d in dimensions]
    gid = F.grouping_id(*base, *dimensions)
    width = len(dimensions)
    out = df.groupingSets(sets, *base, *dimensions).agg(
        *[column.alias(name) for name, column in aggregates.items()], gid.alias("_gid")
    )
    dim = F.lit("total")
    label = F.lit("")
    full = (1 << width) - 1
    for i, name in enumerate(dimensions):
        bits = full & ~(1 << (width - 1 - i))
        dim = F.when(F.col("_gid") == bits, name).otherwise(dim)
        label = F.when(F.col("_gid") == bits, F.col(name).cast("string")).otherwise(label)
    return out.select(*base, dim.alias("dim"), label.alias("label"), *aggregates)


def audit_stats(acl: DataFrame) -> DataFrame:
    return by_dimensions(
        acl,
        ["reason", "username"],
        {
            "entries": F.count(F.lit(1)),
            "users": F.countDistinct(F.col("username")),
            "earliest_ms": F.min("captured_ms"),
            "latest_ms": F.max("captured_ms"),
        },
    )


def anomaly_stats(events: DataFrame) -> DataFrame:
    return by_dimensions(
        events,
        ["severity", "metric", "pattern"],
        {
            "events": F.count(F.lit(1)),
            "active": F.count_if(~F.col("resolved")),
            "resolved_n": F.count_if(F.col("resolved")),
        },
    )


def hit_rate(hits: Column, total: Column) -> Column:
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def cache_stats(operations: DataFrame) -> DataFrame:
    """Hits, misses, hit rate and cost saved overall, per tier and per tool."""
    counted = by_dimensions(
        operations,
        ["tier", "tool"],
        {
            "hits": F.count_if(F.col("hit")),
            "misses": F.count_if(~F.col("hit")),
            "cost_saved_micros": F.coalesce(
                F.sum(F.when(F.col("hit"), F.col("cost_micros"))), F.lit(0).cast("bigint")
            ),
        },
    )
    return counted.withColumn("hit_rate", hit_rate(F.col("hits"), F.col("hits") + F.col("misses")))


def cache_health(samples: DataFrame, threshold: float, band: float) -> DataFrame:
    """Hit, miss and uncertain-hit rates overall and per category, with a warning ladder."""
    hit = F.col("result") == "hit"
    counted = by_dimensions(
        samples,
        ["category"],
        {
            "ops": F.count(F.lit(1)),
            "hits": F.count_if(hit),
            "uncertain": F.count_if(hit & (F.col("score") >= F.lit(threshold) - F.lit(band))),
        },
    )
    rate = hit_rate(F.col("hits"), F.col("ops"))
    uncertain = hit_rate(F.col("uncertain"), F.col("hits"))
    return counted.select(
        "dim",
        "label",
        "ops",
        rate.alias("hit_rate"),
        hit_rate(F.col("ops") - F.col("hits"), F.col("ops")).alias("miss_rate"),
        uncertain.alias("uncertain_hit_rate"),
        (F.col("ops") < 100).alias("warn_few_ops"),
        ((F.col("ops") >= 100) & (rate < 0.2)).alias("warn_low_hit_rate"),
        (uncertain > 0.25).alias("warn_uncertain"),
    )


def agent_cache_health(stats: DataFrame) -> DataFrame:
    """Warning ladder of the tiered cache over the rows of :func:`cache_stats`."""
    ops = F.col("hits") + F.col("misses")
    return stats.select(
        "dim",
        "label",
        ops.alias("ops"),
        "hit_rate",
        (ops < 100).alias("warn_few_ops"),
        ((ops >= 100) & (F.col("hit_rate") < 0.3)).alias("warn_low_hit_rate"),
    )


def similarity_distribution(samples: DataFrame, buckets: int = 20, width: float = 0.1) -> DataFrame:
    """Histogram of scores with empty buckets kept."""
    slot = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(F.col("score") / F.lit(width))))
    counts = samples.groupBy(slot.cast("bigint").alias("bucket")).agg(
        F.count_if(F.col("result") == "hit").alias("h"), F.count_if(F.col("result") != "hit").alias("m")
    )
    grid = samples.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return grid.join(counts, "bucket", "left").select(
        "bucket",
        (F.col("bucket") * F.lit(width)).alias("lower"),
        F.coalesce("h", F.lit(0)).alias("hit_count"),
        F.coalesce("m", F.lit(0)).alias("miss_count"),
    )


def window_summary(samples: DataFrame) -> DataFrame:
    """Sample count, hits and mean score (scores summed exactly as 10^-9 units)."""
    nano = F.round(F.col("score") * 1e9).cast("decimal(19,0)")
    return samples.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("result") != "miss").alias("hits"),
        (F.sum(nano).cast("double") / F.count(F.lit(1)) / F.lit(1e9)).alias("avg_score"),
    )


def instance_sample(counters: DataFrame) -> DataFrame:
    """Counter rows (instance, field, amount) to one row per instance, with cumulative hit rate."""
    wide = counters.groupBy("instance").pivot(
        "field", ["hits", "misses", "cost_saved_micros", "evictions", "items"]
    ).agg(F.sum("amount"))
    total = F.coalesce("hits", F.lit(0)) + F.coalesce("misses", F.lit(0))
    return wide.select(
        "instance",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("misses", F.lit(0)).alias("misses"),
        F.coalesce("cost_saved_micros", F.lit(0)).alias("cost_saved_micros"),
        F.coalesce("evictions", F.lit(0)).alias("evictions"),
        "items",
        F.when(total > 0, F.coalesce("hits", F.lit(0)) / total).alias("hit_rate"),
    )


def event_timeline(events: DataFrame, start_ms: int, end_ms: int, buckets: int = 60) -> DataFrame:
    """Counts and maxima per kind over equal-width buckets; ends are clamped, empty buckets kept.

    ``events`` has (kind, ts_ms, value) with kind slow, critical, warning or latency.
    """
    width = (end_ms - start_ms) / buckets
    raw = F.floor((F.col("ts_ms") - start_ms) / F.lit(width))
    slot = F.greatest(F.lit(0), F.least(raw, F.lit(buckets - 1))).cast("bigint")
    kind = F.col("kind")
    counts = events.groupBy(slot.alias("bucket")).agg(
        F.count_if(kind == "slow").alias("slow"),
        F.max(F.when(kind == "slow", F.col("value"))).alias("slow_max"),
        F.count_if(kind == "critical").alias("critical"),
        F.count_if(kind == "warning").alias("warning"),
        F.max(F.when(kind == "latency", F.col("value"))).alias("latency_max"),
    )
    grid = events.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return grid.join(counts, "bucket", "left").select(
        "bucket",
        (F.lit(start_ms) + F.col("bucket") * F.lit(width)).alias("start_ms"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("slow", "slow_max", "critical", "warning", "latency_max")],
    )


def overhead_report(runs: DataFrame) -> DataFrame:
    """Per workload: mean, population deviation and CV of baseline and monitored runs, and overhead %.

    ``runs`` has (workload, monitored, units) with integer units.
    """
    units, wide = F.col("units").cast("decimal(19,0)"), "decimal(38,0)"
    n, s, q = F.count(F.lit(1)), F.sum(units), F.sum(units * units)
    per = (
        runs.groupBy("workload", "monitored")
        .agg(n.alias("n"), s.alias("s"), q.alias("q"))
        .withColumn("mean", F.col("s").cast("double") / F.col("n"))
        .withColumn(
            "sd",
            F.sqrt((F.col("n").cast(wide) * F.col("q").cast(wide)
                    - F.col("s").cast(wide) * F.col("s").cast(wide)).cast("double"))
            / F.col("n"),
        )
        .withColumn("cv_pct", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean") * 100))
    )
    base = per.where(~F.col("monitored")).select(
        "workload", F.col("mean").alias("base_mean"), F.col("cv_pct").alias("base_cv_pct")
    )
    watched = per.where("monitored").select(
        "workload", F.col("mean").alias("watched_mean"), F.col("cv_pct").alias("watched_cv_pct")
    )
    return base.join(watched, "workload").withColumn(
        "overhead_pct",
        F.when(
            F.col("base_mean") > 0, (F.col("base_mean") - F.col("watched_mean")) / F.col("base_mean") * 100
        ),
    )


# Delivery health limits.
HEALTH_SAMPLE = 100
HEALTHY_RATE = 0.5
FAILURE_RUN_LIMIT = 5


def delivery_health(
    deliveries: DataFrame,
    sample: int = HEALTH_SAMPLE,
    min_rate: float = HEALTHY_RATE,
    max_run: int = FAILURE_RUN_LIMIT,
) -> DataFrame:
    """Success rate and newest run of failures over the last deliveries of each subscriber."""
    from pyspark.sql import Window

    newest = Window.partitionBy("subscriber").orderBy(F.desc("created_ms"), F.desc("id"))
    recent = deliveries.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= sample)
    success = F.col("status") == "success"
    out = recent.groupBy("subscriber").agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.count_if(success).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max("created_ms").alias("last_ms"),
        F.min(F.when(success, F.col("_rn"))).alias("_first_ok"),
        F.collect_list(F.when(F.col("status") == "failed", F.col("_rn"))).alias("_failed_at"),
    )
    before_ok = F.size(
        F.filter("_failed_at", lambda r: F.col("_first_ok").isNull() | (r < F.col("_first_ok")))
    ).cast("bigint")
    rate = F.col("succeeded") / F.col("deliveries")
    return (
        out.withColumn("consecutive_failures", before_ok)
        .withColumn("success_rate", rate)
        .withColumn("healthy", (rate >= min_rate) & (F.col("consecutive_failures") < max_run))
        .drop("_first_ok", "_failed_at")
    )


def delivery_fleet_summary(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count(F.lit(1)).alias("subscribers"),
        F.count_if("healthy").alias("healthy"),
        F.count_if(~F.col("healthy")).alias("unhealthy"),
        (F.sum("succeeded") / F.sum("deliveries")).alias("overall_success_rate"),
    )
