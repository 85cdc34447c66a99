"""Predicates over instance state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Health gate limits and the mean length of a captured line.
MEMORY_LIMIT = 0.85
LAG_LIMIT_BYTES = 10 * 1024 * 1024
LINE_BYTES = 120
AOF_LATENCY_EVENTS = ("aof-fsync-always", "aof-write")


def health_gate(memory_share: Column, oom_events: Column, failover: Column, lag_bytes: Column) -> Column:
    """First reason a capture must not start, or null."""
    return (
        F.when(memory_share >= MEMORY_LIMIT, "memory_above_threshold")
        .when(oom_events > 0, "recent_oom")
        .when(failover, "failover_in_progress")
        .when(lag_bytes >= LAG_LIMIT_BYTES, "replication_lag_elevated")
    )


def percent_indexed(raw: Column) -> Column:
    """0..1 fractions and 0..100 percentages to percent; unreadable text is zero."""
    value = raw.try_cast("double")
    return F.when(value.isNull(), 0.0).when(value <= 1, value * 100).otherwise(value)


def used_percent(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, used / limit * 100)


def capture_size_estimate(ops_per_sec: Column, duration_ms: Column) -> Column:
    """Bytes a capture of this length would take."""
    return F.floor(ops_per_sec * (duration_ms / 1000.0) + 0.5) * LINE_BYTES


def acl_aof_hazard(appendonly: Column, pre_acl: Column, acl_reply: Column) -> Column:
    """``hazard``, ``unverified`` or null for a disabled default user with an append-only file.

    ``acl_reply`` is a struct (denied, flags, commands, keys, channels); null means no readable reply.
    """
    commands = F.split(F.coalesce(acl_reply["commands"], F.lit("")), r"\s+")
    flag = lambda f: F.array_contains(acl_reply["flags"], f)
    denies = F.exists(commands, lambda c: c.startswith("-"))
    all_commands = F.array_contains(commands, "+@all") | F.array_contains(commands, "allcommands") | flag("allcommands")
    all_keys = F.array_contains(F.split(F.coalesce(acl_reply["keys"], F.lit("")), r"\s+"), "~*") | flag("allkeys")
    all_channels = F.array_contains(F.split(F.coalesce(acl_reply["channels"], F.lit("")), r"\s+"), "&*") | flag(
        "allchannels"
    )
    unrestricted = ~denies & all_commands & all_keys & all_channels
    active = F.coalesce(appendonly == "yes", F.lit(False)) & ~F.coalesce(pre_acl, F.lit(False))
    return F.when(active & (acl_reply.isNull() | F.coalesce(acl_reply["denied"], F.lit(False))), "unverified").when(
        active & flag("off") & ~unrestricted, "hazard"
    )


def appendfsync_hazard(
    appendonly: Column,
    appendfsync: Column,
    delayed_fsync: Column,
    rising_streak: Column,
    last_write_status: Column,
    latency_events: Column,
) -> Column:
    """``hazard``, ``advisory`` or null for the append-only file's flush policy."""
    symptom = F.coalesce(last_write_status != "ok", F.lit(False)) | F.arrays_overlap(
        latency_events, F.array(*[F.lit(e) for e in AOF_LATENCY_EVENTS])
    )
    climbing = (rising_streak >= 2) & delayed_fsync.isNotNull()
    on = F.coalesce(appendonly == "yes", F.lit(False))
    return (
        F.when(on & (appendfsync == "always") & symptom, "hazard")
        .when(on & (appendfsync == "always"), "advisory")
        .when(on & (appendfsync == "everysec") & climbing, "hazard")
    )
