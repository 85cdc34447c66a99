"""Detectors over polls of many connections.

Levels, deltas, streaks and episodes are columns built with the slice-carrying series
functions; a fold is used only where a decision depends on earlier decisions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.identity import audit_ip
from fleetscope.operators.quantiles import Quantile, exact_quantiles, with_trailing_median
from fleetscope.operators.series import (
    DAY_MS,
    HOUR_MS,
    last_known,
    over_trailing_range,
    over_trailing_rows,
    previous,
    running_sum,
    scan,
    with_last_known,
    with_previous,
    with_row_index,
    with_running_sum,
    with_streak,
)
from fleetscope.operators.series import streak as run_of
from fleetscope.operators.timeseries import level_escalations, rolling_baseline
from fleetscope.streaming import folds
from fleetscope.streaming.runner import fold_history

MINUTE_MS = 60_000
POLL = ["ts_ms", "id"]


class SpikeConfig(NamedTuple):
    warning_z: float = 2.0
    critical_z: float = 3.0
    warning_value: float | None = None
    critical_value: float | None = None
    consecutive: int = 3
    cooldown_ms: int = 60_000
    detect_drops: bool = False


# Settings of single metrics; all others use the defaults.
SPIKE_CONFIGS = {
    "acl_denied": SpikeConfig(1.5, 2.5, 10, 50, 2, 30_000),
    "memory_used": SpikeConfig(2.5, 3.5, None, None, 3, 60_000),
    "evicted_keys": SpikeConfig(2.0, 3.0, None, None, 2, 30_000),
    "fragmentation_ratio": SpikeConfig(2.0, 3.0, 1.5, 2.0, 5, 120_000),
    "cpu_utilization": SpikeConfig(2.0, 3.0, None, None, 3, 60_000, True),
    "slowlog_last_id": SpikeConfig(1.5, 2.5, None, None, 1, 30_000),
}


def loud_rows(samples: DataFrame, config: SpikeConfig, slice_ms: int = HOUR_MS) -> DataFrame:
    """Samples against their rolling baseline with the severity they would have alone.

    ``samples`` has (connection_id, metric, ts_ms, id, value, cents). Rows before the baseline
    is ready and drops nobody asked for leave no trace and are dropped here.
    """
    rated = rolling_baseline(samples, ["connection_id", "metric"], POLL, "cents", slice_ms=slice_ms)
    z = F.abs("z")
    by_z = F.when(z >= config.critical_z, "critical").when(z >= config.warning_z, "warning")
    high = lambda limit: F.lit(False) if limit is None else F.col("value") >= limit
    severity = F.when(high(config.critical_value), "critical").otherwise(
        F.coalesce(by_z, F.when(high(config.warning_value), "warning"))
    )
    kept = F.col("ready") & ((F.col("z") >= 0) | F.lit(config.detect_drops))
    return rated.where(kept).withColumn("severity", severity)


def spike_events(samples: DataFrame, config: SpikeConfig, slice_ms: int = HOUR_MS) -> DataFrame:
    """Alerts of one metric configuration. A quiet row with no loud row within a cooldown resets."""
    keys = ["connection_id", "metric"]
    rows = loud_rows(samples, config, slice_ms).withColumn(
        "_loud", F.when(F.col("severity").isNotNull(), F.col("ts_ms"))
    )
    marked = with_last_known(rows, keys, POLL, {"_last": "_loud"}, slice_ms)
    quiet = F.col("severity").isNull() & F.coalesce(
        F.col("ts_ms") - F.col("_last") >= config.cooldown_ms, F.lit(True)
    )
    return fold_history(
        marked.select(*keys, *POLL, "severity", "z", "value", "_last"),
        keys,
        POLL,
        folds.spike(config.consecutive, config.cooldown_ms),
        "ts_ms bigint, id bigint, severity string, anomaly_type string, value double",
        reset=quiet,
        slice_ms=slice_ms,
    )


class Rule(NamedTuple):
    pattern: str
    required: tuple[str, ...]
    extra: Column | None = None


def correlation_rules() -> list[Rule]:
    """Ordered rules, the first match wins. Conditions see per-window flags ``spikes``, ``metrics``, ``n``, ``saturated``."""
    spiked = lambda m: F.array_contains("spikes", m)
    seen = lambda m: F.array_contains("metrics", m)
    both = spiked("connections") & spiked("ops_per_sec")
    return [
        Rule("control_plane_saturation", ("cpu_utilization",), F.col("saturated")),
        Rule("auth_attack", ("acl_denied",)),
        Rule("node_failover", ("replication_role",)),
        Rule("node_failover", ("cluster_state",)),
        Rule("persistence_stall", ("persistence_child",)),
        Rule("slow_queries", ("slowlog_last_id",)),
        Rule("memory_pressure", ("memory_used",), spiked("memory_used") & (seen("evicted_keys") | (F.col("n") == 1))),
        Rule("cache_thrashing", ("keyspace_misses", "evicted_keys")),
        Rule("connection_leak", ("connections",), (F.col("first_connection") == "spike") & ~seen("ops_per_sec")),
        Rule("batch_job", ("connections", "ops_per_sec"), both & spiked("memory_used")),
        Rule("traffic_burst", ("connections", "ops_per_sec"), both & ~spiked("memory_used")),
        Rule("traffic_burst", ("ops_per_sec",)),
        Rule("traffic_burst", ("input_kbps",)),
        Rule("traffic_burst", ("output_kbps",)),
        Rule("memory_pressure", ("fragmentation_ratio",)),
        Rule("memory_pressure", ("evicted_keys",)),
        Rule("connection_leak", ("connections",)),
        Rule("slow_queries", ("blocked_clients",)),
        Rule("cache_thrashing", ("keyspace_misses",)),
    ]


def anchor_windows(events: DataFrame, window_ms: int = 5_000) -> DataFrame:
    """Events with the start and head of their first-anchored window.

    A gap longer than the window always starts a new one, so the series is cut there.
    """
    keys = ["connection_id"]
    gaps = with_previous(events, keys, POLL, {"_prev": "ts_ms"}, HOUR_MS)
    starts = F.coalesce(F.col("ts_ms") - F.col("_prev") > window_ms, F.lit(True))
    segments = with_running_sum(gaps, keys, POLL, {"_cut": starts.cast("bigint")}, HOUR_MS)
    anchored = fold_history(
        segments.select(*keys, "_cut", *POLL),
        [*keys, "_cut"],
        POLL,
        folds.anchored_window(window_ms),
        "ts_ms bigint, id bigint, start_ms bigint, head_id bigint",
    )
    return events.join(anchored.drop("_cut"), [*keys, *POLL])


def correlate(events: DataFrame, window_ms: int = 5_000) -> DataFrame:
    """Groups of anomalies that belong together, each with its pattern and highest severity.

    ``events`` has (connection_id, ts_ms, id, metric, anomaly_type, severity, saturated).
    """
    spike = F.col("anomaly_type") == "spike"
    level = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    connection = F.when(F.col("metric") == "connections", F.struct("ts_ms", "id"))
    groups = anchor_windows(events, window_ms).groupBy("connection_id", "start_ms", "head_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set("metric").alias("metrics"),
        F.collect_set(F.when(spike, F.col("metric"))).alias("spikes"),
        F.min_by("anomaly_type", connection).alias("first_connection"),
        F.bool_or("saturated").alias("saturated"),
        F.max(level).alias("level"),
        F.max("ts_ms").alias("end_ms"),
    )
    return with_pattern(groups)


def with_pattern(groups: DataFrame) -> DataFrame:
    """The pattern and severity of anomaly groups: the first rule that holds.

    ``groups`` has (connection_id, start_ms, head_id, n, metrics, spikes, first_connection, saturated, level, end_ms).
    """
    pattern = F.lit("unknown")
    for rule in reversed(correlation_rules()):
        condition = F.lit(True)
        for metric in rule.required:
            condition = condition & F.array_contains("metrics", metric)
        if rule.extra is not None:
            condition = condition & F.coalesce(rule.extra, F.lit(False))
        pattern = F.when(condition, rule.pattern).otherwise(pattern)
    severity = F.when(F.col("level") == 2, "critical").when(F.col("level") == 1, "warning").otherwise("info")
    return groups.select(
        "connection_id",
        "start_ms",
        "head_id",
        "end_ms",
        "n",
        F.array_join(F.array_sort("metrics"), ",").alias("metrics"),
        pattern.alias("pattern"),
        severity.alias("severity"),
    )


# Alert thresholds where a subscriber names none.
ALERT_DEFAULTS = {
    "memory_critical": 90.0,
    "connection_critical": 90.0,
    "compliance_memory": 80.0,
    "slowlog_count": 100.0,
    "replication_lag_seconds": 10.0,
}
#: Subscribers of one setting for each part that its alerts are dealt to.
SHARED_ROWS = 1_000
#: Crossed limits that a task puts out at once.
MARK_ROWS = 100_000


def threshold_alerts(
    readings: DataFrame, subscribers: DataFrame, factor: float = 0.9, defaults: Mapping[str, float] = ALERT_DEFAULTS
) -> DataFrame:
    """First crossings of a threshold, armed again only past the hysteresis band.

    A latch fires when its last change before was a recovery. Between two readings only the limits between
    their values change: these are found by binary search in the sorted limits of the alert, so rows come out
    per change and never per reading and setting. The distinct settings are collected, 24 bytes each, and sent once to
    each task. ``readings`` has (connection_id, alert, ts_ms, id, value), where a null value is no
    reading; ``subscribers`` (subscriber, alert, threshold or null, above).
    """
    table = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    asked = subscribers.withColumn("limit_value", F.coalesce("threshold", table[F.col("alert")])).select(
        "subscriber", "alert", "limit_value", "above"
    )
    # Subscribers with the same setting share one latch; only its alerts are handed to each of them.
    rule = ["alert", "limit_value", "above"]
    # Limits from above are mirrored, so that both kinds are crossed by rising; recovered is below "rest".
    rise = F.when(F.col("above"), F.col("limit_value")).otherwise(-F.col("limit_value"))
    rest = F.least(rise, rise * F.when(F.col("above"), factor).otherwise(2 - factor))
    settings = asked.dropna(subset=rule).groupBy(*rule).agg(F.ceil(F.count(F.lit(1)) / SHARED_ROWS).cast("int").alias("_parts"))
    limits: dict[str, dict[bool, np.ndarray]] = {}
    for (alert, above), part in settings.withColumns({"rise": rise, "rest": rest}).toPandas().groupby(["alert", "above"]):
        ordered = part.sort_values(["rise", "rest", "limit_value"])
        limits.setdefault(alert, {})[bool(above)] = ordered[["rise", "rest", "limit_value", "_parts"]].to_numpy("float64").T
    rows = with_previous(readings.where(F.col("value").isNotNull()), ["connection_id", "alert"], POLL, {"_from": "value"}, DAY_MS)
    told = ["connection_id", "alert", *POLL, "value"]
    kinds = dict(readings.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in told] + ["above boolean", "limit_value double", "_parts int", "_mark int"])
    marks = rows.select(*told, "_from").mapInArrow(lambda batches: _crossed(batches, limits), schema)
    seen = with_previous(marks, ["connection_id", *rule], POLL, {"_before": "_mark"}, DAY_MS)
    fired = seen.where((F.col("_mark") == 1) & (F.coalesce("_before", F.lit(0)) == 0))
    # A setting of many subscribers may fire often: its alerts are dealt to parts, and each part gets all of these subscribers.
    dealt = fired.withColumn("_part", F.pmod(F.xxhash64("connection_id", *POLL), F.col("_parts")).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    handed = asked.join(settings, rule).withColumn("_part", parts).select("subscriber", *rule, "_part")
    return dealt.join(handed, [*rule, "_part"]).select("subscriber", "connection_id", "alert", *POLL, "value", "limit_value")


def _crossed(batches: Iterator[pa.RecordBatch], limits: Mapping[str, Mapping[bool, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The limits that each reading crosses, with their mark: 1 where the level rises, 0 where it falls below the rest."""
    for batch in batches:
        before, now = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_from", "value"))
        first = batch.column("_from").is_null().to_numpy(zero_copy_only=False)
        alerts = batch.column("alert").dictionary_encode()
        codes = alerts.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for code, alert in enumerate(alerts.dictionary.to_pylist()):
            at = np.flatnonzero(codes == code)
            for above, (rise, rest, limit, parts) in limits.get(alert, {}).items():
                level = lambda v: v if above else np.where(np.isnan(v), -np.inf, -v)  # noqa: B023, E731
                met = lambda field, v: np.searchsorted(field, level(v[at]), side="right")  # noqa: B023, E731
                was = lambda field: np.where(first[at], 0, met(field, before))  # noqa: B023, E731
                # An order of both counts is an order of the values: rising changes come from one end, falling ones from the other.
                for mark, start, end in ((1, was(rise), met(rise, now)), (0, met(rest, now), was(rest))):
                    changed = np.flatnonzero(end > start)
                    total = np.cumsum(end[changed] - start[changed])
                    low = 0
                    while low < len(changed):  # at most MARK_ROWS come out at once, or those of one reading
                        done = total[low - 1] if low else 0
                        high = max(low + 1, int(np.searchsorted(total, done + MARK_ROWS, side="right")))
                        own, low = changed[low:high], high
                        n = end[own] - start[own]
                        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)
                        told = batch.select(["connection_id", "alert", *POLL, "value"]).take(pa.array(np.repeat(at[own], n)))
                        made = (np.full(len(place), above), limit[place], parts[place].astype("int32"), np.full(len(place), mark, "int32"))
                        yield pa.RecordBatch.from_arrays(
                            [*told.columns, *map(pa.array, made)], [*told.schema.names, "above", "limit_value", "_parts", "_mark"]
                        )


def count_upto(values: str, field: str, x: Column) -> Column:
    """How many structs of an array have a field of at most x, by binary search; the array ascends by the field."""
    size = F.size(values)

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        right = F.get(F.col(values), middle)[field] <= x
        open_ = s["low"] < s["high"]
        return F.struct(
            F.when(open_ & right, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(open_ & ~right, middle).otherwise(s["high"]).alias("high"),
        )

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda s: s["low"])


def with_episode(df: DataFrame, keys: Sequence[str], order: Sequence[str], ends: Column, out: str) -> DataFrame:
    """Number of rows so far that end an episode: equal for all rows of one episode."""
    return with_running_sum(df, keys, order, {out: ends.cast("bigint")}, DAY_MS)


def first_escalations(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str) -> DataFrame:
    """Rows that raise the highest level since the last row of level zero (levels 1 and 2).

    Per episode these are its first critical row and its first warning row before that, so an
    episode is aggregated and never gathered.
    """
    return escalations_of(with_episode(df, keys, order, F.col(level) == 0, "_episode"), keys, order, level)


def escalations_of(episodes: DataFrame, keys: Sequence[str], order: Sequence[str], level: str) -> DataFrame:
    """The same over rows with their ``_episode``, the number of rows of level zero so far."""
    at = F.struct(*order)
    heads = episodes.where(F.col(level) > 0).groupBy(*keys, "_episode").agg(
        F.min(F.when(F.col(level) == 1, at)).alias("_w"), F.min(F.when(F.col(level) == 2, at)).alias("_c")
    )
    events = F.array_compact(
        F.array(
            F.when(F.col("_w").isNotNull() & (F.col("_c").isNull() | (F.col("_w") < F.col("_c"))), F.struct(F.col("_w").alias("at"), F.lit(1).alias("level"))),
            F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("at"), F.lit(2).alias("level"))),
        )
    )
    return heads.select(*keys, F.explode(events).alias("e")).select(
        *keys, *[F.col(f"e.at.{c}").alias(c) for c in order], F.col("e.level").alias("level")
    )


def client_lockout(polls: DataFrame, used_pct: float = 85.0, streak: int = 3) -> DataFrame:
    """Refused connections and clients held at the ceiling; armed again only after full recovery.

    ``polls`` has (connection_id, ts_ms, id, clients, max_clients, rejected). Polls without a
    readable ceiling are gaps.
    """
    keys = ["connection_id"]
    usable = polls.where(F.col("clients").isNotNull() & (F.col("max_clients") > 0))
    high = F.col("clients") / F.col("max_clients") * 100 >= used_pct
    rated = scan(usable, keys, POLL, {"_base": last_known("rejected", before=True), "_streak": run_of(high)})
    refusing = F.coalesce(F.greatest(F.lit(0), F.col("rejected") - F.col("_base")), F.lit(0)) > 0
    held = F.col("_streak") >= streak
    level = F.when(refusing & held, 2).when(refusing | held, 1).otherwise(0)
    episodes = scan(rated.withColumn("level", level), keys, POLL, {"_episode": running_sum((F.col("level") == 0).cast("bigint"))})
    return escalations_of(episodes, keys, POLL, "level")


def load_saturation(polls: DataFrame, warning: float = 0.8, critical: float = 0.95, hold: int = 3) -> DataFrame:
    """Event loop busyness that stays in a band; a band change restarts the hold, a dip lowers the acknowledged band.

    ``polls`` has (connection_id, ts_ms, id, usec_per_cycle, cycles_per_sec).
    """
    keys = ["connection_id"]
    usable = polls.where((F.col("usec_per_cycle") >= 0) & (F.col("cycles_per_sec") >= 0))
    busy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("usec_per_cycle") * F.col("cycles_per_sec") / 1e6))
    rated = usable.withColumn("busy", busy).withColumn(
        "level", F.when(busy >= critical, 2).when(busy >= warning, 1).otherwise(0)
    )
    indexed = with_row_index(rated, keys, POLL, "_i", DAY_MS)
    changes = with_previous(indexed, keys, POLL, {"_p": "level"}, DAY_MS)
    runs = with_episode(changes, keys, POLL, F.coalesce(F.col("level") != F.col("_p"), F.lit(True)), "_run")
    # One row per run of equal band; from here on the data is as small as the number of band changes.
    per_run = runs.groupBy(*keys, "_run").agg(
        F.max("level").alias("level"), F.min("_i").alias("_start"), F.count(F.lit(1)).alias("_len"), F.min("ts_ms").alias("ts_ms")
    )
    confirmed = (F.col("_len") >= hold) & (F.col("level") > 0)
    settled = confirmed | (F.col("level") == 0)
    grouped = with_running_sum(
        per_run.withColumn("_settled", settled), keys, ["ts_ms", "_run"], {"_g": F.col("_settled").cast("bigint")}, DAY_MS
    ).withColumn("_epoch", F.col("_g") - F.col("_settled").cast("bigint"))
    # The acknowledged band before a run: the last settled band, lowered by unconfirmed dips since.
    lows = grouped.where(~F.col("_settled")).groupBy(*keys, F.col("_g").alias("_epoch")).agg(F.min("level").alias("_low"))
    last = grouped.where("_settled").select(*keys, F.col("_g").alias("_epoch"), F.col("level").alias("_last"))
    fired = (
        grouped.where(confirmed)
        .join(lows, [*keys, "_epoch"], "left")
        .join(last, [*keys, "_epoch"], "left")
        .where(F.col("level") > F.least(F.coalesce("_last", F.lit(0)), F.coalesce("_low", F.lit(2))))
        .select(*keys, "level", (F.col("_start") + (hold - 1)).alias("_i"))
    )
    return indexed.drop("level").join(fired, [*keys, "_i"]).select(*keys, *POLL, "busy", "level")


def memory_overhead(polls: DataFrame, warning: float = 0.3, critical: float = 0.5, note_after: int = 10) -> DataFrame:
    """Non-data memory against the memory limit, on escalation; long runs of broken accounting get one note.

    ``polls`` has (connection_id, ts_ms, id, used, overhead, startup, dataset, dataset_pct, maxmemory,
    policy, evicted_delta).
    """
    keys = ["connection_id"]
    broken = (
        (F.col("overhead") > F.col("used"))
        | (F.col("dataset") > F.col("used"))
        | F.coalesce(F.col("dataset_pct") > 100, F.lit(False))
    )
    marked = polls.withColumn("_broken", broken)
    streaks = with_streak(marked, keys, POLL, F.col("_broken"), "_streak")
    notes = streaks.where(F.col("_broken") & (F.col("_streak") == note_after)).select(
        *keys, *POLL, F.lit(0).alias("level"), F.lit("accounting").alias("kind"), F.lit(None).cast("double").alias("share")
    )
    valid = marked.where(~F.col("_broken") & (F.col("maxmemory") > 0))
    operational = F.greatest(F.lit(0), F.col("overhead") - F.col("startup"))
    share = operational / F.col("maxmemory")
    squeezed = (
        (F.col("policy") != "noeviction")
        & (F.col("evicted_delta") > 0)
        & (share >= warning)
        & (operational > F.col("dataset"))
    )
    level = F.when((share >= critical) | squeezed, 2).when(share >= warning, 1).otherwise(0)
    rated = valid.withColumn("share", share).withColumn("level", level)
    raised = level_escalations(rated, keys, POLL, "level").select(
        *keys, *POLL, "level", F.lit("overhead").alias("kind"), "share"
    )
    return raised.unionByName(notes)


def fork_memory_risk(polls: DataFrame, warning: float = 0.8, critical: float = 0.9, write_rate: float = 1000.0) -> DataFrame:
    """Memory peak of a running or projected save; a live risk outranks a projected one.

    ``polls`` has (connection_id, ts_ms, id, saving, used, rss, cow, last_cow, system, writes_per_sec).
    """
    keys = ["connection_id"]
    known = F.coalesce(F.col("system") > 0, F.lit(False))
    basis = F.coalesce("rss", "used")
    system = F.when(known, F.col("system"))  # a poll without it has no share
    live = (basis + F.coalesce("cow", F.lit(0))) / system
    projected = (basis + F.col("last_cow")) / system
    pressed = (F.coalesce("last_cow", F.lit(0)) > 0) & F.coalesce(F.col("writes_per_sec") >= write_rate, F.lit(False))
    score = (
        F.when(~known, 0)
        .when(F.col("saving") & (live >= critical), 21)
        .when(F.col("saving") & (live >= warning), 11)
        .when(~F.col("saving") & pressed & (projected >= warning), 10)
        .otherwise(0)
    )
    rated = polls.withColumn("score", score).withColumn("share", F.when(F.col("saving"), live).otherwise(projected))
    return level_escalations(rated, keys, POLL, "score").select(
        *keys,
        *POLL,
        F.when(F.col("score") == 21, "critical").otherwise("warning").alias("severity"),
        F.when(F.col("score") == 10, "projected").otherwise("live").alias("kind"),
        "share",
    )


PRESSURE_MEMORY_MS = 300_000


def replica_buffer_pressure(
    buffers: DataFrame, warning: float = 0.6, critical: float = 0.9
) -> DataFrame:
    """Escalations of each replica's output buffer against the hard and the sustained soft limit.

    ``buffers`` has (connection_id, addr, ts_ms, id, omem, hard_bytes, soft_bytes, soft_seconds), one
    row per replica and poll.
    """
    keys = ["connection_id", "addr"]
    raised = _buffer_levels(buffers, warning, critical)
    seen = with_previous(raised, keys, POLL, {"_level": "level", "_at": "ts_ms"}, HOUR_MS)
    before = F.when(F.col("ts_ms") - F.col("_at") > PRESSURE_MEMORY_MS, 0).otherwise(F.coalesce("_level", F.lit(0)))
    return seen.where(F.col("level") > before).select(*keys, *POLL, "level", "kind")


def _buffer_levels(buffers: DataFrame, warning: float, critical: float) -> DataFrame:
    keys = ["connection_id", "addr"]
    hard = F.when(F.col("hard_bytes") > 0, F.col("omem") / F.col("hard_bytes")).otherwise(0.0)
    over_hard = hard >= warning
    soft = ~over_hard & (F.col("soft_bytes") > 0) & (F.col("soft_seconds") > 0) & (
        F.col("omem") >= F.col("soft_bytes") * warning
    )
    rows = buffers.withColumn("_hard", hard).withColumn("_soft", soft)
    episodes = with_episode(rows, keys, POLL, ~over_hard & ~soft, "_breach")
    since = (
        episodes.where("_soft").groupBy(*keys, "_breach").agg(F.min("ts_ms").alias("_since"))
    )
    joined = episodes.join(since, [*keys, "_breach"], "left")
    sustained = F.col("_soft") & (F.col("ts_ms") - F.col("_since") > F.col("soft_seconds") * 1000)
    return (
        joined.withColumn(
            "level", F.when(F.col("_hard") >= critical, 2).when(F.col("_hard") >= warning, 1).when(sustained, 1).otherwise(0)
        )
        .withColumn("kind", F.when(sustained, "soft_sustained").otherwise("hard_approach"))
        .withColumn("pressured", over_hard | F.col("_soft"))
        .drop("_hard", "_soft", "_breach", "_since")
    )


def resync_after_pressure(buffers: DataFrame, syncs: DataFrame, warning: float = 0.6, critical: float = 0.9) -> DataFrame:
    """Full syncs right after a pressured replica's connection vanished; once per five minutes.

    ``syncs`` has (connection_id, ts_ms, sync_full_delta) per poll. Sightings and syncs are read once in order
    of time, in slots of an hour; sightings of a slot's last five minutes are also handed to the next one.
    """
    levels = _buffer_levels(buffers, warning, critical)
    known = F.col("connection_id").isNotNull() & F.col("ts_ms").isNotNull()
    slot = F.floor(F.col("ts_ms") / HOUR_MS)
    late = F.pmod(F.col("ts_ms"), F.lit(HOUR_MS)) >= HOUR_MS - PRESSURE_MEMORY_MS
    seen = levels.where(known).groupBy("connection_id", "addr", "ts_ms").agg(F.max("pressured").alias("pressured"))
    sightings = seen.withColumn("_slot", F.explode(F.when(late, F.array(slot, slot + 1)).otherwise(F.array(slot))))
    polls = syncs.where(known & (F.col("sync_full_delta") > 0)).select("connection_id", "ts_ms").distinct().withColumn("_slot", slot)
    # A healthy sighting at the time of a sync clears the memory, so sightings come before syncs (_kind).
    both = sightings.withColumn("_kind", F.lit(0)).unionByName(polls.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    out = f"ts_ms bigint, addr {dict(buffers.dtypes)['addr']}"
    hits = fold_history(
        both.select("connection_id", "_slot", F.col("ts_ms").cast("bigint").alias("ts_ms"), F.col("_kind").alias("kind"), "addr", "pressured"),
        ["connection_id", "_slot"], ["ts_ms", "kind", "addr"], folds.sync_after_pressure(PRESSURE_MEMORY_MS), out,
    ).drop("_slot")
    return fold_history(
        hits, ["connection_id"], ["ts_ms"], folds.cooldown(PRESSURE_MEMORY_MS, True, ("addr",)), out, forgets_ms=PRESSURE_MEMORY_MS
    )


def unexplained_resyncs(syncs: DataFrame, window_ms: int = PRESSURE_MEMORY_MS, needed: int = 2) -> DataFrame:
    """Full syncs beyond replica growth where no buffer limit can be read; once per five minutes.

    ``syncs`` has (connection_id, ts_ms, id, sync_full_delta, replicas).
    """
    keys = ["connection_id"]
    grown = with_previous(syncs, keys, POLL, {"_before": "replicas"}, DAY_MS)
    growth = F.greatest(F.lit(0), F.col("replicas") - F.coalesce("_before", F.col("replicas")))
    odd = F.greatest(F.lit(0), F.col("sync_full_delta") - growth)
    counted = over_trailing_range(
        grown.withColumn("_odd", odd).where(F.col("_odd") > 0), keys, "ts_ms", window_ms, {"recent": F.sum("_odd")}
    )
    hits = counted.where(F.col("recent") >= needed).groupBy(*keys, "ts_ms").agg(F.max("recent").alias("recent"))
    fired = fold_history(
        hits.select(*keys, "ts_ms"), keys, ["ts_ms"], folds.cooldown(window_ms, True), "ts_ms bigint", forgets_ms=window_ms
    )
    return fired.join(hits, [*keys, "ts_ms"])


def control_plane_saturation(polls: DataFrame, events: DataFrame, cpu_pct: float = 90.0, streak: int = 3) -> DataFrame:
    """CPU at the ceiling together with slow probes, control-plane anomalies or dropped replicas.

    ``polls`` has (connection_id, ts_ms, id, cpu_pct or null, rtt_ms, replica_drops, restart);
    ``events`` (connection_id, ts_ms) of control-plane anomalies. Evidence counts for 60 s.
    """
    keys = ["connection_id"]
    runs = with_episode(polls, keys, POLL, F.col("restart"), "_boot")
    window = over_trailing_rows(
        runs.where(F.col("rtt_ms").isNotNull()), [*keys, "_boot"], POLL, 31, {"_rtts": F.collect_list("rtt_ms")}, DAY_MS
    )
    earlier = F.array_sort(F.slice("_rtts", 1, F.greatest(F.size("_rtts") - 1, F.lit(0))))
    upper = F.get(earlier, F.floor(F.size(earlier) / 2).cast("int"))
    slow = (F.size(earlier) >= 5) & (F.col("rtt_ms") >= 100) & (F.col("rtt_ms") >= upper * 4)
    spikes = window.select(*keys, *POLL, slow.alias("rtt_spike"))
    known = runs.where(F.col("cpu_pct").isNotNull() | F.col("restart"))
    hot = F.coalesce(F.col("cpu_pct") >= cpu_pct, F.lit(False)) & ~F.col("restart")
    counted = with_streak(known, keys, POLL, hot, "_streak")
    episodes = with_episode(counted, keys, POLL, ~hot, "episode")
    # Evidence comes before the polls of its time (_kind), so that totals up to a poll hold all of that time.
    kinds = polls.where(F.col("replica_drops") > 0).select(
        *keys, "ts_ms", F.lit(1).alias("_kind"), F.col("replica_drops").cast("bigint").alias("_drops")
    ).unionByName(events.select(*keys, "ts_ms", F.lit(1).alias("_kind"), F.col("ts_ms").alias("_event")), allowMissingColumns=True)
    rows = episodes.where((F.col("_streak") >= streak) | F.col("restart")).select(
        *keys, *POLL, "episode", "restart", F.lit(2).alias("_kind")
    )
    both = with_running_sum(
        rows.unionByName(kinds, allowMissingColumns=True), keys, ["ts_ms", "_kind", "id"],
        {"total": F.coalesce("_drops", F.lit(0).cast("bigint"))}, DAY_MS,
    )
    evidence = over_trailing_range(
        both, keys, "ts_ms", MINUTE_MS,
        {"recent": F.sum(F.coalesce("_drops", F.lit(0).cast("bigint"))), "event_ms": F.max("_event")},
    ).where(F.col("_kind") == 2)
    ready = evidence.join(spikes, [*keys, *POLL], "left").withColumn("rtt_spike", F.coalesce("rtt_spike", F.lit(False)))
    # A new episode after a minute without rows owes nothing to what was before: the fold starts anew there.
    before = with_previous(ready.drop("_kind", "_drops", "_event"), keys, POLL, {"_last": "ts_ms", "_was": "episode"}, DAY_MS)
    fresh = F.coalesce((F.col("ts_ms") - F.col("_last") > MINUTE_MS) & (F.col("episode") != F.col("_was")), F.lit(True))
    parts = with_running_sum(before.withColumn("_fresh", fresh.cast("bigint")), keys, POLL, {"_part": "_fresh"}, DAY_MS)
    found = fold_history(
        parts.drop("_last", "_was", "_fresh"), [*keys, "_part"], POLL, folds.saturation_episode(), "ts_ms bigint, id bigint, reasons string"
    )
    return found.drop("_part")


def resync_loop(polls: DataFrame, min_ms: int = 300_000, cycles: int = 2) -> DataFrame:
    """Replicas that keep failing to sync while their link stays down; one finding per window.

    ``polls`` has (connection_id, ts_ms, id, role, link, down_s, syncing). A smaller down counter
    means the link came up in between.
    """
    keys = ["connection_id"]
    down = F.coalesce(F.col("role").isin("slave", "replica") & (F.col("link") == "down"), F.lit(False))
    # What a poll of the same outage last said: a poll outside of outages says nothing.
    said = lambda c: last_known(F.when(~F.col("_down"), F.struct(F.lit(None).cast(kinds[c]).alias("v"))).when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), before=True)
    kinds = dict(polls.dtypes)
    before = scan(
        polls.withColumn("_down", down), keys, POLL,
        {"_base": said("down_s"), "_was": said("syncing"), "_before": previous("_down")},
    ).where("_down")
    dropped = F.coalesce(F.col("down_s") < F.col("_base.v"), F.lit(False))
    starts = dropped | ~F.coalesce("_before", F.lit(False))
    ended = ~dropped & F.coalesce(F.col("_was.v"), F.lit(False)) & ~F.col("syncing")
    counted = scan(before.withColumn("_starts", starts), keys, POLL, {"_ended": running_sum(F.coalesce(ended, F.lit(False)).cast("bigint"))})
    # A window's first poll and how many syncs had failed by then; none fails on that poll.
    first = F.when(F.col("_starts"), F.struct("ts_ms", "id", "_ended"))
    windows = scan(counted, keys, POLL, {"_first": last_known(first)})
    failed = F.col("_ended") - F.col("_first._ended")
    late = windows.where((F.col("ts_ms") - F.col("_first.ts_ms") >= min_ms) & (failed >= cycles))
    return (
        late.groupBy(*keys, F.col("_first.ts_ms").alias("_s"), F.col("_first.id").alias("_i"))
        .agg(F.min_by(F.struct(*POLL, failed.alias("failed_cycles")), F.struct(*POLL)).alias("f"))
        .select(*keys, "f.*")
    )


def shard_owners(nodes: DataFrame) -> DataFrame:
    """One observation per poll and shard: the live claimant with the highest epoch, smallest id on ties.

    ``nodes`` has (connection_id, ts_ms, shard, node_id, epoch, live, unhealthy, resharding).
    """
    claim = F.struct((-F.col("epoch")).alias("e"), F.col("node_id").alias("n"), F.col("resharding").alias("r"))
    return (
        nodes.groupBy("connection_id", "shard", "ts_ms")
        .agg(
            F.min(F.when(F.col("live"), claim)).alias("c"),
            F.collect_set(F.when(F.col("unhealthy"), F.col("node_id"))).alias("unhealthy"),
        )
        .where(F.col("c").isNotNull())
        .select(
            "connection_id", "shard", "ts_ms", (-F.col("c.e")).alias("epoch"), F.col("c.n").alias("owner"),
            F.col("c.r").alias("resharding"), "unhealthy",
        )
    )


def failover_churn(nodes: DataFrame) -> DataFrame:
    """Shards whose owner or epoch keeps changing within a minute.

    The fold forgets a shard that was not seen for two windows, so its series is cut there.
    """
    return fold_history(
        shard_owners(nodes), ["connection_id", "shard"], ["ts_ms"], folds.failover_churn(MINUTE_MS),
        "ts_ms bigint, changes bigint, severity string", forgets_ms=2 * MINUTE_MS,
    )


def raft_health(polls: DataFrame, churn_ms: int = MINUTE_MS, recovered_ms: int = 30_000) -> DataFrame:
    """Election churn and leaderless outages. (connection_id, ts_ms, id, role, term, commit).

    With a column ``node_timeout_ms`` the times of an outage follow from each poll's node timeout (null or not
    positive: 15 seconds), and ``recovered_ms`` is not used.

    Only elections enter the first fold. The second is cut wherever the node leads or has not
    been seeking for the recovery time, since no outage can be open after such a poll.
    """
    keys = ["connection_id"]
    seeking = F.when(F.col("role").isin("candidate", "pre-candidate"), F.col("ts_ms"))
    known = with_last_known(polls.withColumn("_s", seeking), keys, POLL, {"_seek": "_s"}, DAY_MS)
    timed = [c for c in polls.columns if c == "node_timeout_ms"]
    quiet = F.lit(recovered_ms)
    if timed:
        timeout = F.when(F.col(*timed) > 0, F.col(*timed)).otherwise(folds.NODE_TIMEOUT_MS)
        quiet = F.greatest(F.lit(folds.RECOVERED_FLOOR_MS), F.least(timeout, F.lit(folds.NODE_TIMEOUT_MAX_MS)) * 3)
    calm = F.col("_s").isNull() & F.coalesce(F.col("ts_ms") - F.col("_seek") >= quiet, F.lit(True))
    outages = fold_history(
        known.select(*keys, *POLL, "role", "commit", "_s", "_seek", *timed), keys, POLL, folds.leaderless(recovered_ms),
        "ts_ms bigint, kind string, amount bigint", closes=(F.col("role") == "leader") | calm,
    )
    terms = with_previous(polls, keys, POLL, {"_term": "term"}, DAY_MS)
    elections = terms.where(F.col("term") > F.col("_term")).select(*keys, *POLL)
    gaps = with_previous(elections, keys, POLL, {"_prev": "ts_ms"}, DAY_MS)
    far = F.coalesce(F.col("ts_ms") - F.col("_prev") > churn_ms, F.lit(True))
    cut = with_episode(gaps, keys, POLL, far, "_cut").select(*keys, "_cut", *POLL)
    churn = fold_history(
        cut, [*keys, "_cut"], POLL, folds.election_churn(churn_ms), "ts_ms bigint, kind string, amount bigint"
    ).drop("_cut")
    return outages.unionByName(churn)


def persistence_stall(polls: DataFrame, stall_s: int = 60, warn_s: int = 120, crit_s: int = 600) -> DataFrame:
    """Saves that fail, freeze or run long, per child process.

    ``polls`` has (connection_id, child, ts_ms, id, in_progress, elapsed_s, processed, total, status).
    An idle poll with a clean status leaves no state behind and cuts the series.
    """
    keys = ["connection_id", "child"]
    idle = ~F.col("in_progress") & (F.coalesce("status", F.lit("")) == "ok")
    return fold_history(
        polls, keys, POLL, folds.persistence_stall(stall_s, warn_s, crit_s), "ts_ms bigint, reason string", reset=idle
    )


def forget_rejoin(sightings: DataFrame) -> DataFrame:
    """Nodes forgotten and gossiped back in. (connection_id, ts_ms, node_id, live), one row per node and poll."""
    conn = ["connection_id"]
    polls = sightings.groupBy(*conn, "ts_ms").agg(F.count(F.lit(1)).alias("_seen"))
    numbered = with_row_index(polls, conn, ["ts_ms"], "poll", DAY_MS)
    linked = with_previous(numbered, conn, ["ts_ms"], {"prior_ms": "ts_ms", "_prior_seen": "_seen"}, DAY_MS)
    reset = (F.col("_seen") <= 1) & (F.col("_prior_seen") - F.col("_seen") >= 2)
    counted = with_running_sum(
        linked.withColumn("_r", F.coalesce(reset, F.lit(False)).cast("bigint")), conn, ["ts_ms"], {"resets_with": "_r"}, DAY_MS
    ).withColumn("resets", F.col("resets_with") - F.col("_r"))
    times = counted.select(*conn, F.col("poll").alias("_next"), F.col("ts_ms").alias("left_ms"))
    keys = [*conn, "node_id"]
    rows = sightings.join(counted.select(*conn, "ts_ms", "poll", "prior_ms", "resets", "resets_with"), [*conn, "ts_ms"])
    seen = with_previous(rows, keys, ["ts_ms"], {"_poll": "poll"}, DAY_MS)
    gaps = seen.withColumn("_next", F.col("_poll") + 1).join(times, [*conn, "_next"], "left")
    out = "departed_ms bigint, returned_ms bigint, absent_polls bigint"
    return fold_history(
        gaps.select(*keys, "ts_ms", "poll", "live", "prior_ms", "resets", "resets_with", "left_ms"),
        keys, ["ts_ms"], folds.forget_rejoin(), out,
    )


def auth_failure_bursts(
    entries: DataFrame, window_ms: int = 300_000, needed: int = 10, wait_ms: int = 900_000, reason: str = "auth"
) -> DataFrame:
    """Client addresses with many authentication failures in the window, once per cooldown.

    ``entries`` has (connection_id, entry_id, ts_ms (scan), count, created_ms, reason, client_info):
    cumulative counters. An entry first seen counts in full only if it was created inside the window.
    """
    entry = ["connection_id", "entry_id"]
    seen = with_previous(entries.where(F.col("reason") == reason), entry, ["ts_ms"], {"_c": "count", "_at": "ts_ms"}, DAY_MS)
    known = F.col("_c").isNotNull() & (F.col("ts_ms") - F.col("_at") < window_ms * 4)
    delta = F.when(known, F.greatest(F.lit(0), F.col("count") - F.col("_c"))).otherwise(
        F.when(F.col("created_ms") >= F.col("ts_ms") - window_ms, F.col("count")).otherwise(0)
    )
    source = ["connection_id", "client_ip"]
    grown = (
        seen.withColumn("client_ip", audit_ip(F.col("client_info")))
        .where((F.coalesce("client_ip", F.lit("")) != "") & F.col("connection_id").isNotNull() & F.col("ts_ms").isNotNull())
        .groupBy(*source, "ts_ms")
        .agg(F.sum(delta).cast("bigint").alias("_d"))
    )
    # What grew comes in at its time and goes out again a window later, before what comes in then (_in): one running sum.
    change = lambda at, d, comes: F.struct(at.alias("ts_ms"), d.alias("_d"), F.lit(comes).alias("_in"))
    both = F.explode(F.array(change(F.col("ts_ms"), F.col("_d"), True), change(F.col("ts_ms") + window_ms, -F.col("_d"), False)))
    summed = with_running_sum(grown.select(*source, both.alias("e")).select(*source, "e.*"), source, ["ts_ms", "_in"], {"failures": "_d"}, HOUR_MS)
    hits = summed.where(F.col("_in") & (F.col("failures") >= needed)).select(*source, "ts_ms", "failures")
    return fold_history(
        hits, source, ["ts_ms"], folds.cooldown(wait_ms, carried=("failures",)), "ts_ms bigint, failures bigint", forgets_ms=wait_ms
    )


def sla_breaches(ticks: DataFrame, limit_us: float, wait_ms: int = 600_000) -> DataFrame:
    """Index latency above its ceiling: at the start of an episode and again after the debounce.

    ``ticks`` has (connection_id, bucket, ts_ms, p99). A tick at or below the ceiling ends the episode.
    """
    keys = ["connection_id", "bucket"]
    return fold_history(
        ticks.select(*keys, "ts_ms", "p99"), keys, ["ts_ms"], folds.cooldown(wait_ms, True), "ts_ms bigint",
        reset=F.col("p99") <= limit_us,
    ).join(ticks.select(*keys, "ts_ms", "p99"), [*keys, "ts_ms"])


def _eligible(samples: DataFrame, min_calls: float = 60.0, top: int = 20) -> DataFrame:
    """Samples of the busiest commands of each poll. One poll lists a bounded number of commands."""
    poll = Window.partitionBy("connection_id", "ts_ms").orderBy(F.desc("calls_per_min"), "command")
    ranked = samples.withColumn("_rank", F.row_number().over(poll))
    return ranked.withColumn("eligible", (F.col("calls_per_min") >= min_calls) & (F.col("_rank") <= top)).drop("_rank")


def _degraded(current: Column, baseline: Column, factor: float) -> Column:
    return (current >= baseline * factor) & (current - baseline >= 1000)


def upgrade_windows(samples: DataFrame, span_ms: int = DAY_MS) -> DataFrame:
    """Periods after a rise of the major version, until a later change or a day has passed."""
    keys = ["connection_id"]
    polls = samples.where(F.col("major").isNotNull()).groupBy(*keys, "ts_ms").agg(F.max("major").alias("major"))
    seen = with_previous(polls, keys, ["ts_ms"], {"from_major": "major"}, DAY_MS)
    changes = seen.where(F.col("from_major") != F.col("major"))
    # Version changes are few; their order per connection is a small window.
    nxt = F.lead("ts_ms").over(Window.partitionBy(*keys).orderBy("ts_ms"))
    return (
        changes.withColumn("_next", nxt)
        .where(F.col("major") > F.col("from_major"))
        .select(
            *keys, "from_major", F.col("major").alias("to_major"), F.col("ts_ms").alias("opened_ms"),
            F.least(F.col("ts_ms") + span_ms, F.coalesce(F.col("_next") - 1, F.col("ts_ms") + span_ms)).alias("closed_ms"),
        )
    )


def within(rows: DataFrame, windows: DataFrame, on: list[str], start: Column, end: Column, slot_ms: int = DAY_MS) -> DataFrame:
    """rows joined with the windows of equal ``on`` that hold their ts_ms, both ends included.

    Both sides meet in slots of time, so a row is paired only with windows that touch its slot.
    """
    slot = lambda c: F.floor(c / slot_ms)
    cut = windows.where(start <= end).withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    return (
        rows.withColumn("_slot", slot(F.col("ts_ms")))
        .join(cut, [*on, "_slot"])
        .where(F.col("ts_ms").between(start, end))
        .drop("_slot")
    )


def upgrade_regressions(samples: DataFrame, factor: float = 1.5, needed: int = 5, lookback_ms: int = 6 * HOUR_MS) -> DataFrame:
    """Commands slower after a major upgrade than on the old major line, once per upgrade.

    ``samples`` has (connection_id, command, ts_ms, p99_us, major, calls_per_min).
    """
    windows = upgrade_windows(samples)
    window = ["connection_id", "opened_ms"]
    conn, opened, closed = ["connection_id"], F.col("opened_ms"), F.col("closed_ms")
    old = within(samples, windows, conn, opened - lookback_ms, opened).where(F.col("major") == F.col("from_major"))
    base = exact_quantiles(old, [*window, "command"], "p99_us", [Quantile("baseline_us", "linear", 0.5)]).where(F.col("n") >= 5)
    after = within(_eligible(samples), windows, conn, opened, closed).join(base.drop("n"), [*window, "command"])
    bad = F.col("eligible") & (F.col("major") >= F.col("to_major")) & _degraded(F.col("p99_us"), F.col("baseline_us"), factor)
    runs = with_streak(after.withColumn("_bad", bad), [*window, "command"], ["ts_ms"], F.col("_bad"), "_streak")
    ripe = runs.where(F.col("_streak") >= needed)
    first = ripe.groupBy(*window).agg(F.min("ts_ms").alias("ts_ms"))
    return ripe.join(first, [*window, "ts_ms"]).select(
        *window, "ts_ms", "command", "baseline_us", "p99_us",
        F.when((F.col("p99_us") >= F.col("baseline_us") * 3) | (F.col("p99_us") >= 100_000), "critical").otherwise("warning").alias("severity"),
    )


def sustained_regressions(samples: DataFrame, factor: float = 2.0, needed: int = 5, wait_ms: int = 1_800_000) -> DataFrame:
    """Commands that stay at twice their median of the last day, outside open upgrade windows."""
    keys = ["connection_id", "command"]
    based = with_trailing_median(
        _eligible(samples), keys, "ts_ms", "p99_us", DAY_MS, 5 * MINUTE_MS, "baseline_us", "_n"
    ).where("eligible")
    windows = upgrade_windows(samples).select("connection_id", F.col("opened_ms"), F.col("closed_ms"))
    owned = (
        within(based.select(*keys, "ts_ms"), windows, ["connection_id"], F.col("opened_ms"), F.col("closed_ms"))
        .select(*keys, "ts_ms")
        .distinct()
        .withColumn("_owned", F.lit(True))
    )
    usable = F.col("_owned").isNull() & (F.col("_n") >= 30)
    judged = based.join(owned, [*keys, "ts_ms"], "left").withColumn(
        "degraded", F.coalesce(usable & _degraded(F.col("p99_us"), F.col("baseline_us"), factor), F.lit(False))
    )
    loud = judged.withColumn("_at", F.when(F.col("degraded"), F.col("ts_ms")))
    marked = with_last_known(loud, keys, ["ts_ms"], {"_last": "_at"}, DAY_MS)
    calm = ~F.col("degraded") & F.coalesce(F.col("ts_ms") - F.col("_last") >= wait_ms, F.lit(True))
    return fold_history(
        marked.select(*keys, "ts_ms", "degraded", "p99_us", "baseline_us", "_last"),
        keys, ["ts_ms"], folds.sustained_regression(needed, wait_ms),
        "ts_ms bigint, p99_us double, baseline_us double", reset=calm,
    )


def persistence_gate(findings: DataFrame, polls: DataFrame, grace_ms: int) -> DataFrame:
    """Findings that persisted for the grace time, reported once until they clear.

    ``findings`` has (connection_id, signature, ts_ms); ``polls`` (connection_id, ts_ms) of the polls that
    succeeded. A failed poll is a gap, not a recovery: only successful polls are numbered.
    """
    conn, keys = ["connection_id"], ["connection_id", "signature"]
    numbered = with_row_index(polls.select(*conn, "ts_ms").distinct(), conn, ["ts_ms"], "_poll", DAY_MS)
    rows = findings.join(numbered, [*conn, "ts_ms"])
    seen = with_previous(rows, keys, ["ts_ms"], {"_before": "_poll"}, DAY_MS)
    fresh = F.coalesce(F.col("_poll") - F.col("_before") > 1, F.lit(True))
    spells = with_episode(seen, keys, ["ts_ms"], fresh, "_spell")
    starts = spells.groupBy(*keys, "_spell").agg(F.min("ts_ms").alias("since_ms"))
    ripe = spells.join(starts, [*keys, "_spell"]).where(F.col("ts_ms") - F.col("since_ms") >= grace_ms)
    return ripe.groupBy(*keys, "_spell", "since_ms").agg(F.min("ts_ms").alias("alert_ms")).drop("_spell")


def session_intervals(reads: DataFrame, ttl_ms: int) -> DataFrame:
    """Live spans of sliding-expiry sessions. (thread_id, ts_ms, id): each touch keeps it alive for the TTL."""
    keys = ["thread_id"]
    seen = with_previous(reads, keys, POLL, {"_prev": "ts_ms"}, DAY_MS)
    fresh = F.coalesce(F.col("ts_ms") - F.col("_prev") >= ttl_ms, F.lit(True))
    return (
        with_episode(seen, keys, POLL, fresh, "_session")
        .groupBy(*keys, "_session")
        .agg(F.min("ts_ms").alias("start_ms"), (F.max("ts_ms") + ttl_ms).alias("expires_ms"), F.count(F.lit(1)).alias("touches"))
        .drop("_session")
    )


def session_stream(reads: DataFrame, ttl: str, late: str) -> DataFrame:
    """The same spans over a stream with a timestamp column ``ts``."""
    return (
        reads.withWatermark("ts", late)
        .groupBy("thread_id", F.session_window("ts", ttl).alias("w"))
        .agg(F.count(F.lit(1)).alias("touches"))
        .select("thread_id", F.col("w.start").alias("start"), F.col("w.end").alias("expires"), "touches")
    )


def admitted_requests(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Sliding-window admission. (rate_key, ts_ms, id). A pause of a whole window empties the state."""
    keys = ["rate_key"]
    seen = with_previous(requests, keys, POLL, {"_prev": "ts_ms"}, HOUR_MS)
    cut = with_running_sum(
        seen, keys, POLL, {"_cut": F.coalesce(F.col("ts_ms") - F.col("_prev") >= window_ms, F.lit(True)).cast("bigint")}, HOUR_MS
    )
    return fold_history(
        cut.select(*keys, "_cut", *POLL), [*keys, "_cut"], POLL, folds.rate_limit(limit, window_ms),
        "ts_ms bigint, id bigint, admitted boolean, remaining bigint, retry_after_ms bigint",
    ).drop("_cut")


def miss_cost_backfill(events: DataFrame, hold_ms: int = 300_000) -> DataFrame:
    """Cost of each store given to the oldest pending miss of its prompt. (prompt, ts_ms, id, kind, cost)."""
    keys = ["prompt"]
    seen = with_previous(events, keys, POLL, {"_prev": "ts_ms"}, HOUR_MS)
    cut = with_running_sum(
        seen, keys, POLL, {"_cut": F.coalesce(F.col("ts_ms") - F.col("_prev") > hold_ms, F.lit(True)).cast("bigint")}, HOUR_MS
    )
    return fold_history(
        cut.select(*keys, "_cut", *POLL, "kind", "cost"), [*keys, "_cut"], POLL, folds.pending_costs(hold_ms),
        "miss_id bigint, store_id bigint, cost bigint",
    ).drop("_cut")


def expire_proposals(proposals: DataFrame, now_ms: int) -> DataFrame:
    """Pending proposals past their time become expired. (proposal_id, status, expires_ms)."""
    due = (F.col("status") == "pending") & (F.col("expires_ms") <= now_ms)
    return proposals.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def latest_proposal_status(audit: DataFrame) -> DataFrame:
    """Present status from the audit log. (proposal_id, ts_ms, id, status)."""
    return audit.groupBy("proposal_id").agg(
        F.max_by("status", F.struct(*POLL)).alias("status"), F.count(F.lit(1)).alias("changes")
    )


def outcome_evaluation(
    adjustments: DataFrame, samples: DataFrame, band: float = 0.05, change: float = 0.10
) -> DataFrame:
    """Whether an applied threshold change moved its target rate the right way.

    ``adjustments`` has (proposal_id, category, applied_ms, until_ms, threshold, signal, before_rate);
    samples of the category recorded from the change on are judged at the new threshold.
    """
    rated = samples.select("category", "ts_ms", "score", "result")
    joined = within(rated, adjustments, ["category"], F.col("applied_ms"), F.col("until_ms"))
    hit, score, t = F.col("result") == "hit", F.col("score"), F.col("threshold")
    counted = joined.groupBy("proposal_id", "signal", "before_rate").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(hit).alias("_h"),
        F.count_if(hit & (score >= t - F.lit(band))).alias("_u"),
        F.count_if(hit & (score > t / 2)).alias("_d"),
        F.count_if(~hit & (score > t) & (score <= t + F.lit(band))).alias("_m"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    after = (
        F.when(F.col("signal") == "uncertain_hits", ratio(F.col("_u"), F.col("_h")))
        .when(F.col("signal") == "distant_hits", ratio(F.col("_d"), F.col("_h")))
        .when(F.col("signal") == "near_misses", ratio(F.col("_m"), F.col("samples") - F.col("_h")))
        .when(F.col("signal") == "low_hit_rate", F.col("_h") / F.col("samples"))
    )
    before = F.col("before_rate")
    moved = F.when(before == 0, F.when(F.col("after_rate") == 0, 0.0).otherwise(1.0)).otherwise(
        (F.col("after_rate") - before) / before
    )
    better = F.when(F.col("signal") == "low_hit_rate", moved).otherwise(-moved)
    return counted.withColumn("after_rate", after).select(
        "proposal_id",
        "signal",
        "samples",
        "before_rate",
        "after_rate",
        F.when(F.col("after_rate").isNull(), "neutral")
        .when(better > change, "improved")
        .when(better < -change, "degraded")
        .otherwise("neutral")
        .alias("verdict"),
    )


def reconcile_facts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Operations that bring the existing facts in line with a batch, subject by subject.

    Both have (scope, subject, statement, date); ``existing`` has an id for the order of doubles,
    ``incoming`` a sequence number and a tombstone flag. Subjects match without case and edge blanks.
    """
    fold_key = F.lower(F.trim("subject"))
    shape = lambda df, incoming_flag, seq, tombstone: df.select(
        "scope", fold_key.alias("subject_key"), F.lit(incoming_flag).alias("incoming"), seq.alias("seq"), "statement", "date", tombstone.alias("tombstone")
    )
    rows = shape(existing, False, F.col("id"), F.lit(False)).unionByName(shape(incoming, True, F.col("seq"), F.col("tombstone")))
    return fold_history(
        rows, ["scope", "subject_key"], ["incoming", "seq"], folds.reconcile_facts(),
        "seq bigint, op string, statement string, date string",
    )
