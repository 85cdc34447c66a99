"""Command captures against their baseline, triggers, subscriptions and sampled validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.keys import command_shape
from fleetscope.operators.quantiles import Quantile, exact_quantiles
from fleetscope.operators.series import DAY_MS, HOUR_MS, with_last_known

WEEK_MS = 7 * DAY_MS
HOT_K = 50


def baseline_window(kind: str, session_start_ms: int) -> tuple[int, int]:
    """Start and end of the period a capture is compared with."""
    spans = {"6h": 6 * HOUR_MS, "24h": DAY_MS, "7d": WEEK_MS}
    if kind == "same-hour-last-week":
        return session_start_ms - WEEK_MS, session_start_ms - WEEK_MS + HOUR_MS
    return session_start_ms - spans[kind], session_start_ms


def between(df: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return df.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") <= end_ms))


def new_shapes(capture: DataFrame, baseline_log: DataFrame, baseline_clients: DataFrame | None = None) -> DataFrame:
    """Shapes of the capture the baseline lacks, both exactly and as a verb seen on any client.

    ``capture`` and ``baseline_log`` have args; ``baseline_clients`` has cmd.
    """
    counts = capture.groupBy("connection_id", command_shape(F.col("args")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n")
    )
    seen = baseline_log.select("connection_id", command_shape(F.col("args")).alias("shape")).distinct()
    fresh = counts.join(seen, ["connection_id", "shape"], "left_anti").withColumn(
        "verb", F.substring_index("shape", ":", 1)
    )
    if baseline_clients is None:
        return fresh
    verbs = (
        baseline_clients.where(F.col("cmd") != "")
        .select("connection_id", F.upper("cmd").alias("verb"))
        .distinct()
    )
    return fresh.join(verbs, ["connection_id", "verb"], "left_anti")


def _key_counts(rows: DataFrame, count: str) -> DataFrame:
    """Uses of each key per connection."""
    return (
        rows.where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("connection_id", "key")
        .agg(F.count(F.lit(1)).alias(count))
    )


def hot_key_delta(capture: DataFrame, baseline: DataFrame, k: int = HOT_K) -> DataFrame:
    """Hottest keys of the capture that are new among the hottest, or changed their rank."""
    order = Window.partitionBy("connection_id")
    now = _key_counts(capture, "n_capture")
    before = _key_counts(baseline, "n_baseline")
    top_now = now.withColumn(
        "rank_capture", F.row_number().over(order.orderBy(F.desc("n_capture"), "key")).cast("bigint")
    ).where(F.col("rank_capture") <= k)
    top_before = (
        before.withColumn(
            "rank_baseline", F.row_number().over(order.orderBy(F.desc("n_baseline"), "key")).cast("bigint")
        )
        .where(F.col("rank_baseline") <= k)
        .drop("n_baseline")
    )
    return (
        top_now.join(before, ["connection_id", "key"], "left")
        .join(top_before, ["connection_id", "key"], "left")
        .withColumn("n_baseline", F.coalesce("n_baseline", F.lit(0)))
        .withColumn(
            "change",
            F.when(F.col("rank_baseline").isNull(), "new").when(
                F.col("rank_baseline") != F.col("rank_capture"), "moved"
            ),
        )
        .where(F.col("change").isNotNull())
    )


def slowlog_regressions(
    capture: DataFrame,
    baseline: DataFrame,
    session: DataFrame,
    baseline_ms: tuple[int, int],
    session_ms: tuple[int, int],
) -> DataFrame:
    """Captured verbs whose slow-entry rate in the session beats the 95th percentile baseline rate."""
    base_s = max(1.0, (baseline_ms[1] - baseline_ms[0]) / 1000)
    session_s = max(1.0, (session_ms[1] - session_ms[0]) / 1000)
    keys = ["connection_id"]
    verb = F.upper("verb").alias("verb")
    captured = capture.select("connection_id", verb).distinct()
    base = baseline.groupBy("connection_id", verb).agg(F.count(F.lit(1)).alias("n_baseline"))
    seen = session.groupBy("connection_id", verb).agg(F.count(F.lit(1)).alias("n_session"))
    rates = base.withColumn("rate", F.col("n_baseline") / F.lit(base_s))
    p95 = exact_quantiles(rates, keys, "rate", [Quantile("p95_rate", "linear", 0.95)]).drop("n")
    return (
        captured.join(seen, ["connection_id", "verb"])
        .join(base, ["connection_id", "verb"], "left")
        .join(p95, keys, "left")
        .withColumn("observed_rate", F.col("n_session") / F.lit(session_s))
        .withColumn("baseline_rate", F.coalesce("n_baseline", F.lit(0)) / F.lit(base_s))
        .withColumn("p95_rate", F.coalesce("p95_rate", F.lit(0.0)))
        .where(F.col("observed_rate") > F.col("p95_rate"))
        .drop("n_baseline")
    )


def capture_diff(captures: DataFrame, left: str, right: str, k: int = HOT_K) -> DataFrame:
    """Shapes and hot keys of one capture against another. (capture_id, connection_id, args, key)."""
    if left == right:
        raise ValueError("a capture cannot be compared with itself")
    a = captures.where(F.col("capture_id") == left)
    b = captures.where(F.col("capture_id") == right)
    shapes = new_shapes(b, a).select(
        "connection_id", F.lit("shape").alias("kind"), F.col("shape").alias("item"), F.lit("new").alias("change")
    )
    keys = hot_key_delta(b, a, k).select(
        "connection_id", F.lit("key").alias("kind"), F.col("key").alias("item"), "change"
    )
    return shapes.unionByName(keys)


def match_triggers(triggers: DataFrame, anomalies: DataFrame) -> DataFrame:
    """First anomaly that fires each armed trigger, with the outcome.

    Both sides share (connection_id, metric, anomaly_type). The first anomaly at or after
    a trigger's creation is found by carrying anomalies backwards in time over the union
    of both series, so no trigger meets every anomaly of its key. ``anomalies`` also has
    (ts_ms, id, blocked, busy); ``triggers`` (trigger_id, created_ms, expires_ms).
    """
    keys = ["connection_id", "metric", "anomaly_type"]
    event = F.struct("ts_ms", "id", "blocked", "busy")
    kind = "struct<ts_ms:bigint,id:bigint,blocked:boolean,busy:boolean>"
    union = triggers.select(
        *keys, "trigger_id", "created_ms", "expires_ms",
        (-F.col("created_ms")).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("bigint").alias("_i"),
        F.lit(None).cast(kind).alias("event"),
    ).unionByName(
        anomalies.select(
            *keys, (-F.col("ts_ms")).alias("_t"), F.lit(0).alias("_k"), (-F.col("id")).alias("_i"),
            event.cast(kind).alias("event"),
        ),
        allowMissingColumns=True,
    )
    carried = with_last_known(union, keys, ["_t", "_k", "_i"], {"hit": "event"}, DAY_MS)
    live = (F.col("hit").isNotNull()) & (F.col("hit.ts_ms") < F.col("expires_ms"))
    return carried.where(F.col("_k") == 1).select(
        "trigger_id",
        *keys,
        F.when(live, F.col("hit.id")).alias("anomaly_id"),
        F.when(live, F.col("hit.ts_ms")).alias("fired_ms"),
        F.when(~live | live.isNull(), "expired")
        .when(F.col("hit.blocked"), "skipped")
        .when(F.col("hit.busy"), "queued")
        .otherwise("fired")
        .alias("status"),
    )


def subscriptions(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Subscribers of each event: same event type, and same connection unless they watch all.

    ``subscribers`` has (subscriber, connection_id or null, event_types array); it is exploded
    to equi-join keys, one join for scoped and one for global subscribers.
    """
    wanted = subscribers.select(
        "subscriber", F.col("connection_id").alias("scope"), F.explode("event_types").alias("event_type")
    )
    scoped = wanted.where(F.col("scope").isNotNull()).withColumnRenamed("scope", "connection_id")
    everywhere = wanted.where(F.col("scope").isNull()).drop("scope")
    return events.join(scoped, ["connection_id", "event_type"]).unionByName(
        events.join(everywhere, "event_type")
    )


def dead_letters(deliveries: DataFrame, policies: DataFrame, default_max: int = 3) -> DataFrame:
    """Failed deliveries out of attempts. (subscriber, status, attempts) with (subscriber, max_retries)."""
    limit = F.coalesce("max_retries", F.lit(default_max))
    return (
        deliveries.where(F.col("status") == "failed")
        .join(policies, "subscriber", "left")
        .where(F.col("attempts") >= limit)
        .drop("max_retries")
    )


def validate_sample(source: DataFrame, target: DataFrame) -> DataFrame:
    """Outcome per sampled source key against the target. (key, key_type, value_hash) on both sides.

    Values are compared by a hash taken per type where the keys are read.
    """
    other = target.select(
        "key", F.col("key_type").alias("_type"), F.col("value_hash").alias("_hash"), F.lit(True).alias("_there")
    )
    return source.where(F.col("key_type") != "none").join(other, "key", "left").select(
        "key",
        "key_type",
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("_type") != F.col("key_type"), "type_mismatch")
        .when(~F.col("_hash").eqNullSafe(F.col("value_hash")), "value_mismatch")
        .otherwise("match")
        .alias("status"),
    )


def sample_keys(keys: DataFrame, share: float, seed: int = 7) -> DataFrame:
    """A repeatable sample: the decision depends on the key alone, not on row order or partitions."""
    digest = F.md5(F.concat(F.col("key"), F.lit(f"#{seed}")))
    position = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return keys.where(position < int(share * (1 << 32)))


def explanation(hit: Column, exists: Column) -> Column:
    """Class of a span against the key's present state."""
    return (
        F.when(exists.isNull() & ~hit, "miss-below-threshold")
        .when(exists.isNull(), "no-key")
        .when(~hit & exists, "cold-miss")
        .when(~hit & ~exists, "uncached")
        .when(hit & ~exists, "gone-since")
        .when(hit & exists, "present")
        .otherwise(F.when(exists, "key-present").otherwise("key-absent"))
    )


def correlate_spans(spans: DataFrame, keys: DataFrame, instances: DataFrame) -> DataFrame:
    """Cache spans with the present state of their key, instance threshold and index state.

    ``spans`` has (span_id, cache_key, instance, hit); ``keys`` (cache_key, ttl_s) of live keys;
    ``instances`` (instance, threshold, index_state). Spans naming neither key nor instance are left out.
    """
    instance = F.coalesce(
        F.when(F.col("cache_key").contains(":"), F.substring_index("cache_key", ":", 1)), F.col("instance")
    )
    named = spans.withColumn("instance", instance).where(
        F.col("cache_key").isNotNull() | F.col("instance").isNotNull()
    )
    live = keys.select("cache_key", "ttl_s", F.lit(True).alias("_live"))
    joined = named.join(live, "cache_key", "left").join(instances, "instance", "left")
    exists = F.when(F.col("cache_key").isNotNull(), F.coalesce("_live", F.lit(False)))
    return joined.select(
        "span_id",
        "cache_key",
        "instance",
        "hit",
        exists.alias("exists_now"),
        F.when(F.col("cache_key").isNotNull(), F.coalesce("ttl_s", F.lit(-2))).alias("ttl_now_s"),
        "threshold",
        "index_state",
        explanation(F.col("hit"), exists).alias("explanation"),
        F.coalesce(F.col("index_state") != "ready", F.lit(False)).alias("degraded_index"),
    )


def latest_batch(rows: DataFrame, newest: bool = True) -> DataFrame:
    """Rows of the newest (or oldest) capture of each connection and signal."""
    pick = F.max("captured_ms") if newest else F.min("captured_ms")
    ends = rows.groupBy("connection_id", "signal").agg(pick.alias("captured_ms"))
    return rows.join(ends, ["connection_id", "signal", "captured_ms"], "left_semi")


def current_composites(rows: DataFrame, signal: str = "composite") -> DataFrame:
    """Newest composite batch, unless any other signal of the connection was captured later."""
    ends = rows.groupBy("connection_id").agg(
        F.max(F.when(F.col("signal") == signal, F.col("captured_ms"))).alias("_mine"),
        F.max("captured_ms").alias("_any"),
    )
    current = ends.where(F.col("_mine") == F.col("_any")).select(
        "connection_id", F.col("_mine").alias("captured_ms")
    )
    return rows.where(F.col("signal") == signal).join(current, ["connection_id", "captured_ms"], "left_semi")


def live_instances(registry: DataFrame, heartbeats: DataFrame, samples: DataFrame) -> DataFrame:
    """Registered instances with liveness and newest sample."""
    latest = samples.groupBy("instance").agg(
        F.max_by(F.struct("ts_ms", "hits", "misses"), F.struct("ts_ms", "id")).alias("s")
    )
    alive = heartbeats.select("instance").distinct().withColumn("_alive", F.lit(True))
    return (
        registry.join(alive, "instance", "left")
        .join(latest, "instance", "left")
        .select(
            "instance",
            "kind",
            F.coalesce("_alive", F.lit(False)).alias("alive"),
            F.col("s.ts_ms").alias("sampled_ms"),
            F.col("s.hits").alias("hits"),
            F.col("s.misses").alias("misses"),
        )
    )


def tool_effectiveness(stats: DataFrame, policies: DataFrame, tier_ttl: int | None, default_ttl: int | None) -> DataFrame:
    """Hit rate, effective TTL and TTL advice per tool. (tool, hits, misses) with (tool, ttl_s)."""
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.col("hits") / total).otherwise(F.lit(0.0))
    ttl = F.coalesce("ttl_s", F.lit(tier_ttl).cast("bigint"), F.lit(default_ttl).cast("bigint"))
    advice = (
        F.when((rate > 0.8) & F.coalesce(ttl < 3600, F.lit(False)), "increase_ttl")
        .when(rate >= 0.4, "optimal")
        .otherwise("decrease_ttl_or_disable")
    )
    return stats.join(policies, "tool", "left").select(
        "tool", rate.alias("hit_rate"), ttl.alias("effective_ttl_s"), advice.alias("advice")
    )
