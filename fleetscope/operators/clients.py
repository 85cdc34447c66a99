"""Analytics over client-list snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.identity import (
    address_host,
    buffer_advice,
    client_identity,
    idle_advice,
    labelled,
)
from fleetscope.operators.quantiles import Quantile, exact_quantiles
from fleetscope.operators.scopes import scoped, with_totals

MINUTE_MS = 60_000


def _identity() -> Column:
    return client_identity(F.col("name"), F.col("addr"))


def command_distribution(clients: DataFrame, group_by: str = "name", keys: Sequence[str] = ()) -> DataFrame:
    """Commands per identity with the identity's top command and share of all snapshots of its scope."""
    identity = {
        "name": labelled(F.col("name"), "(unnamed)"),
        "user": labelled(F.col("user_name"), "(default)"),
        "addr": F.col("addr"),
    }[group_by]
    per = scoped(clients, keys).groupBy(*keys, identity.alias("identifier"), "cmd").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("cmd").isNotNull() & (F.col("cmd") != "")
    heads = per.groupBy(*keys, "identifier").agg(
        F.sum("n").alias("snapshots"),
        F.sum(F.when(named, F.col("n"))).alias("total_commands"),
        F.min_by("cmd", F.when(named, F.struct(-F.col("n"), F.col("cmd")))).alias("top_command"),
    )
    totals = with_totals(heads, keys, _all=F.sum("snapshots"))
    shared = totals.withColumn("activity_pct", F.col("snapshots") / F.col("_all") * 100).drop("_all")
    return per.where(named).join(shared, [*keys, "identifier"])


def idle_connections(
    clients: DataFrame, threshold_s: int = 300, min_occurrences: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    return (
        scoped(clients, keys)
        .where(F.col("idle") >= threshold_s)
        .groupBy(*keys, _identity().alias("identifier"))
        .agg(
            F.avg("idle").alias("avg_idle"),
            F.max("idle").alias("max_idle"),
            F.count(F.lit(1)).alias("occurrences"),
            F.min("captured_ms").alias("first_seen"),
            F.max("captured_ms").alias("last_seen"),
        )
        .where(F.col("occurrences") >= min_occurrences)
        .withColumn("advice", idle_advice(F.col("avg_idle"), F.col("occurrences")))
    )


def buffer_anomalies(
    clients: DataFrame, qbuf_limit: int = 1_000_000, omem_limit: int = 10_000_000, keys: Sequence[str] = ()
) -> DataFrame:
    critical = (F.col("omem") > omem_limit * 10) | (F.col("qbuf") > qbuf_limit * 10)
    return scoped(clients, keys).where((F.col("qbuf") > qbuf_limit) | (F.col("omem") > omem_limit)).select(
        *keys,
        "id",
        _identity().alias("identifier"),
        "addr",
        "captured_ms",
        "qbuf",
        "omem",
        labelled(F.col("cmd"), "(none)").alias("last_command"),
        F.when(critical, "critical").otherwise("warning").alias("severity"),
        buffer_advice(F.col("qbuf"), F.col("omem")).alias("advice"),
    )


def buffer_stats(clients: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, maximum and floor-index 95th percentile of both buffers, one row per buffer."""
    by = [*keys, "buffer"]
    long = scoped(clients, keys).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("qbuf").alias("buffer"), F.col("qbuf").alias("size")),
                F.struct(F.lit("omem").alias("buffer"), F.col("omem").alias("size")),
            )
        ).alias("r")
    ).select(*keys, "r.buffer", "r.size")
    p95 = exact_quantiles(long, by, "size", [Quantile("p95", "floor", 0.95)])
    means = long.groupBy(*by).agg(F.avg("size").alias("avg_size"), F.max("size").alias("max_size"))
    return means.join(p95, by)


def activity_timeline(clients: DataFrame, bucket_minutes: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    width = bucket_minutes * MINUTE_MS
    bucket = (F.floor(F.col("captured_ms") / width) * width).alias("bucket_ms")
    return scoped(clients, keys).groupBy(*keys, bucket).agg(
        F.countDistinct(_identity()).alias("unique_clients"),
        F.count(F.lit(1)).alias("connections"),
        F.count_if(F.col("cmd") != "").alias("commands"),
        F.avg("idle").alias("avg_idle"),
        F.max("qbuf").alias("max_qbuf"),
        F.max("omem").alias("max_omem"),
    )


def activity_commands(clients: DataFrame, bucket_minutes: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Command counts per bucket, long form."""
    width = bucket_minutes * MINUTE_MS
    return (
        scoped(clients, keys)
        .where(F.col("cmd") != "")
        .groupBy(*keys, (F.floor(F.col("captured_ms") / width) * width).alias("bucket_ms"), "cmd")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def client_spikes(
    clients: DataFrame, sensitivity: float = 2.0, bucket_minutes: int = 5, keys: Sequence[str] = ()
) -> DataFrame:
    """Buckets far above the mean bucket of their scope, for connections and for output buffers.

    The mean and deviation come from exact integer sums over one row per bucket.
    """
    buckets = activity_timeline(clients, bucket_minutes, keys)

    def sums(value: str) -> Column:
        # n*q exceeds 64 bits for byte gauges, so the products are decimals.
        wide = F.col(value).cast("decimal(18,0)")
        square = (wide * wide).cast("decimal(26,0)")
        return F.struct(
            F.count(F.lit(1)).cast("decimal(10,0)").alias("n"), F.sum(wide).alias("s"), F.sum(square).alias("q")
        )

    def baseline(t: Column, floor_factor: float) -> tuple[Column, Column]:
        n, s, q = t["n"], t["s"].cast("decimal(19,0)"), t["q"].cast("decimal(27,0)")
        mean = s.cast("double") / n.cast("double")
        spread = F.sqrt((n * q - s * s).cast("double")) / n.cast("double")
        return mean, F.greatest(mean + spread * F.lit(sensitivity), mean * F.lit(floor_factor))

    summed = with_totals(buckets, keys, _c=sums("connections"), _b=sums("max_omem"))
    c_mean, c_limit = baseline(F.col("_c"), 1.5)
    b_mean, b_limit = baseline(F.col("_b"), 2.0)
    rated = summed.withColumns({"c_mean": c_mean, "c_limit": c_limit, "b_mean": b_mean, "b_limit": b_limit})
    rows = F.array(
        F.struct(
            F.lit("connections").alias("metric"),
            F.col("connections").cast("double").alias("value"),
            F.col("c_mean").alias("baseline"),
            F.col("c_limit").alias("limit_value"),
        ),
        F.struct(
            F.lit("buffer").alias("metric"),
            F.col("max_omem").cast("double").alias("value"),
            F.col("b_mean").alias("baseline"),
            F.col("b_limit").alias("limit_value"),
        ),
    )
    return (
        rated.select(*keys, "bucket_ms", F.explode(rows).alias("r"))
        .select(*keys, "bucket_ms", "r.*")
        .where(F.col("value") > F.col("limit_value"))
        .withColumn("deviation", F.col("value") - F.col("baseline"))
    )


def spike_contributors(
    clients: DataFrame, sensitivity: float = 2.0, bucket_minutes: int = 5, top: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """Clients that make up the connection spikes."""
    width = bucket_minutes * MINUTE_MS
    by = [*keys, "bucket_ms"]
    spikes = client_spikes(clients, sensitivity, bucket_minutes, keys).where(F.col("metric") == "connections")
    per = scoped(clients, keys).groupBy(
        *keys,
        (F.floor(F.col("captured_ms") / width) * width).alias("bucket_ms"),
        _identity().alias("identifier"),
    ).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "identifier"))
    return (
        per.join(spikes.select(*by, "value"), by)
        .withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= top)
        .select(*by, "rank", "identifier", (F.col("n") / F.col("value") * 100).alias("contribution"))
    )


def commands_per_minute(clients: DataFrame, bucket_minutes: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    return activity_timeline(clients, bucket_minutes, keys).groupBy(*keys).agg(
        (F.sum("commands") / (F.count(F.lit(1)) * bucket_minutes)).alias("avg_commands_per_minute")
    )


def client_time_series(clients: DataFrame, bucket_ms: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per bucket: rows, and per name/user/ip the number of distinct (name, user, addr) groups."""
    groups = scoped(clients, keys).groupBy(
        *keys,
        (F.floor(F.col("captured_ms") / bucket_ms) * bucket_ms).alias("bucket_ms"),
        "name",
        "user_name",
        "addr",
    ).agg(F.count(F.lit(1)).alias("rows"))
    dims = F.array(
        F.struct(F.lit("total").alias("dim"), F.lit("").alias("label")),
        F.struct(F.lit("name").alias("dim"), F.col("name").alias("label")),
        F.struct(F.lit("user").alias("dim"), F.col("user_name").alias("label")),
        F.struct(F.lit("ip").alias("dim"), address_host(F.col("addr")).alias("label")),
    )
    return (
        groups.select(*keys, "bucket_ms", "rows", F.explode(dims).alias("d"))
        .where((F.col("d.dim") == "total") | (F.col("d.label") != ""))
        .groupBy(*keys, "bucket_ms", F.col("d.dim").alias("dim"), F.col("d.label").alias("label"))
        .agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("_rows"))
        .select(
            *keys,
            "bucket_ms",
            "dim",
            "label",
            F.when(F.col("dim") == "total", F.col("_rows")).otherwise(F.col("groups")).alias("n"),
        )
    )


def client_stats(clients: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Current, peak and distinct counts overall and by name, user and user+name, in one pass.

    Rows are first reduced to one per (capture, name, user); the grouping sets run on those. The current
    capture is the newest one of the scope.
    """
    parts = [*keys, "captured_ms", "name", "user_name"]
    per_capture = (
        scoped(clients, keys).groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"), F.sum("age").alias("ages"))
    )
    sets = per_capture.groupingSets(
        [
            (*keys, "captured_ms", "name"),
            (*keys, "captured_ms", "user_name"),
            (*keys, "captured_ms", "name", "user_name"),
            (*keys, "captured_ms"),
        ],
        *parts,
    ).agg(
        F.sum("rows").alias("rows"),
        F.sum("ages").alias("ages"),
        F.grouping_id(*parts).alias("gid"),
    )
    scope = (
        F.when(F.col("gid") == 1, "name")
        .when(F.col("gid") == 2, "user")
        .when(F.col("gid") == 0, "user_name")
        .otherwise("all")
    )
    newest = with_totals(sets, keys, latest_ms=F.max("captured_ms"))
    return newest.groupBy(
        *keys,
        scope.alias("scope"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("user_name", F.lit("")).alias("user_name"),
    ).agg(
        F.sum(F.when(F.col("captured_ms") == F.col("latest_ms"), F.col("rows")).otherwise(0)).alias("current_n"),
        F.max("rows").alias("peak_n"),
        F.min_by("captured_ms", F.struct(-F.col("rows"), F.col("captured_ms"))).alias("peak_ms"),
        (F.sum("ages") / F.sum("rows")).alias("avg_age"),
    )


def client_uniques(clients: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return scoped(clients, keys).groupBy(*keys).agg(
        F.countDistinct("name").alias("unique_names"),
        F.countDistinct("user_name").alias("unique_users"),
        F.countDistinct(address_host(F.col("addr"))).alias("unique_ips"),
        F.min("captured_ms").alias("earliest_ms"),
        F.max("captured_ms").alias("latest_ms"),
    )
