"""Who issued a command: labels, addresses, advice ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def client_identity(name: Column, addr: Column) -> Column:
    """Client name, or its address when unnamed."""
    return F.coalesce(F.nullif(name, F.lit("")), addr)


def labelled(value: Column, label: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(label))


def address_host(addr: Column) -> Column:
    """Text before the first colon."""
    return F.substring_index(addr, ":", 1)


def audit_ip(client_info: Column) -> Column:
    """Host of the ``addr=`` field: bracketed IPv6, else everything before the last colon."""
    addr = F.regexp_extract(client_info, r"(?:^|\s)addr=(\S+)", 1)
    bracketed = F.regexp_extract(addr, r"^\[([^\]]+)\]", 1)
    return F.when(bracketed != "", bracketed).when(
        addr.contains(":"), F.regexp_extract(addr, r"^(.*):[^:]*$", 1)
    ).otherwise(F.nullif(addr, F.lit("")))


def idle_advice(avg_idle: Column, occurrences: Column) -> Column:
    return (
        F.when((avg_idle > 3600) & (occurrences > 100), "zombie")
        .when((avg_idle > 300) & (occurrences > 50), "stale")
        .otherwise("watch")
    )


def buffer_advice(qbuf: Column, omem: Column) -> Column:
    return (
        F.when(omem > 100_000_000, "huge-output")
        .when(qbuf > 10_000_000, "oversized-input")
        .when(omem > 10_000_000, "large-output")
        .otherwise("elevated")
    )
