"""Rows from captured status dumps (section text, client lists, node lists, nested replies)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kv_entries(line: Column, separator: str) -> Column:
    """``k=v`` pairs of a line, split at the first ``=`` only, as an array of structs."""
    pieces = F.filter(F.split(line, separator), lambda p: F.instr(p, "=") > 1)
    named = F.transform(
        pieces,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("k"),
            F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"),
        ),
    )
    return F.filter(named, lambda e: e["k"] != "")


def kv_get(entries: Column, key: str) -> Column:
    """Value of a key; the last one wins."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]


def _number(text: Column, kind: str = "double") -> Column:
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def info_rows(dumps: DataFrame, column: str = "text") -> DataFrame:
    """(…, section, name, value) of section-headed ``name:value`` dumps.

    The dump is cut at its section headers, so a line finds its section without a window.
    Lines before the first header are dropped.
    """
    chunks = F.split(F.concat(F.lit("\r\n"), F.col(column)), r"\r\n\s*# ")
    others = [c for c in dumps.columns if c != column]
    sections = dumps.select(*others, F.explode(F.slice(chunks, 2, F.size(chunks))).alias("_chunk"))
    lines = sections.select(
        *others,
        F.lower(F.trim(F.split("_chunk", "\r\n")[0])).alias("section"),
        F.explode(F.slice(F.split("_chunk", "\r\n"), 2, F.size(F.split("_chunk", "\r\n")))).alias("_line"),
    ).withColumn("_line", F.trim("_line"))
    return lines.where(~F.col("_line").startswith("#") & F.col("_line").contains(":")).select(
        *others,
        "section",
        F.substring_index("_line", ":", 1).alias("name"),
        F.regexp_extract("_line", r"(?s)^[^:]*:(.*)$", 1).alias("value"),
    )


def commandstats_rows(info: DataFrame) -> DataFrame:
    """Per-command totals; anything not numeric is zero."""
    prefix = "cmdstat_"
    others = [c for c in info.columns if c not in ("section", "name", "value")]
    fields = kv_entries(F.col("value"), ",")
    rows = info.where((F.col("section") == "commandstats") & F.col("name").startswith(prefix)).withColumn("_f", fields)
    get = lambda k, kind="bigint": _number(kv_get(F.col("_f"), k).try_cast("double"), "double").cast(kind)
    return rows.select(
        *others,
        F.lower(F.expr(f"substring(name, {len(prefix) + 1})")).alias("command"),
        get("calls").alias("calls"),
        get("usec").alias("usec"),
        get("usec_per_call", "double").alias("usec_per_call"),
        get("rejected_calls").alias("rejected_calls"),
        get("failed_calls").alias("failed_calls"),
    )


def latencystats_rows(info: DataFrame) -> DataFrame:
    """Per-command percentiles; commands without a p99 are left out."""
    prefix = "latency_percentiles_usec_"
    others = [c for c in info.columns if c not in ("section", "name", "value")]
    rows = info.where((F.col("section") == "latencystats") & F.col("name").startswith(prefix)).withColumn(
        "_f", kv_entries(F.col("value"), ",")
    )
    get = lambda k: kv_get(F.col("_f"), k).try_cast("double")
    return rows.where(get("p99").isNotNull()).select(
        *others,
        F.lower(F.expr(f"substring(name, {len(prefix) + 1})")).alias("command"),
        F.coalesce(get("p50"), F.lit(0.0)).alias("p50_us"),
        get("p99").alias("p99_us"),
        F.coalesce(get("p99.9"), F.lit(0.0)).alias("p999_us"),
    )


def keysizes_rows(dumps: DataFrame, column: str = "text") -> DataFrame:
    """(…, db, type, metric, bucket, n) of key-size distribution lines."""
    pattern = r"^db(\d+)_distrib_([a-z]+)_(sizes|items):(.+)$"
    others = [c for c in dumps.columns if c != column]
    lines = dumps.select(*others, F.explode(F.split(column, r"\r?\n")).alias("_l")).withColumn("_l", F.trim("_l"))
    part = lambda i: F.regexp_extract("_l", pattern, i)
    pairs = lines.where(F.col("_l").rlike(pattern)).select(
        *others,
        F.concat(F.lit("db"), part(1)).alias("db"),
        part(2).alias("type"),
        part(3).alias("metric"),
        F.explode(F.split(part(4), ",")).alias("_p"),
    )
    count = F.regexp_extract("_p", r"^[^=]+=(.*)$", 1).try_cast("double")
    return pairs.where(F.col("_p").contains("=") & count.isNotNull() & ~F.col("_p").startswith("=")).select(
        *others, "db", "type", "metric", F.substring_index("_p", "=", 1).alias("bucket"), count.cast("bigint").alias("n")
    )


# Numeric fields of a client list line.
CLIENT_NUMBERS = {
    "age": "age",
    "idle": "idle",
    "db": "db",
    "sub": "sub",
    "psub": "psub",
    "multi": "multi",
    "qbuf": "qbuf",
    "qbuf-free": "qbuf_free",
    "obl": "obl",
    "oll": "oll",
    "omem": "omem",
}
CLIENT_TEXTS = {"id": "client_id", "addr": "addr", "name": "name", "flags": "flags", "events": "events", "cmd": "cmd", "user": "user_name"}


def client_list_rows(dumps: DataFrame, column: str = "text") -> DataFrame:
    others = [c for c in dumps.columns if c != column]
    lines = dumps.select(*others, F.explode(F.split(F.trim(F.col(column)), "\n")).alias("_l")).withColumn(
        "_f", kv_entries(F.col("_l"), " ")
    )
    return lines.select(
        *others,
        *[F.coalesce(kv_get(F.col("_f"), k), F.lit("")).alias(n) for k, n in CLIENT_TEXTS.items()],
        *[
            F.coalesce(F.regexp_extract(F.coalesce(kv_get(F.col("_f"), k), F.lit("")), r"^\s*(-?\d+)", 1).try_cast("bigint"), F.lit(0)).alias(n)
            for k, n in CLIENT_NUMBERS.items()
        ],
    )


def cluster_nodes_rows(dumps: DataFrame, column: str = "text") -> DataFrame:
    """One row per node line, with slot ranges and migration markers."""
    others = [c for c in dumps.columns if c != column]
    lines = dumps.select(*others, F.explode(F.split(F.trim(F.col(column)), "\n")).alias("_l")).withColumn(
        "_p", F.split("_l", " ")
    )
    at = lambda i: F.coalesce(F.get("_p", F.lit(i)), F.lit(""))
    slots = F.slice("_p", 9, F.greatest(F.size("_p") - 8, F.lit(0)))
    plain = F.filter(slots, lambda s: s.rlike(r"^\d+(-\d+)?$"))
    marked = lambda arrow: F.transform(
        F.filter(slots, lambda s: s.rlike(rf"(?i)\[\d+{arrow}[a-f0-9]+\]")),
        lambda s: F.regexp_extract(s, r"\[(\d+)", 1).cast("bigint"),
    )
    whole = lambda i: F.coalesce(at(i).try_cast("bigint"), F.lit(0))
    return lines.where(F.col("_l") != "").select(
        *others,
        at(0).alias("node_id"),
        F.substring_index(at(1), ",", 1).alias("address"),
        F.when(at(1).contains(","), F.regexp_extract(at(1), r"^[^,]*,(.*)$", 1)).otherwise("").alias("hostname"),
        F.split(at(2), ",").alias("flags"),
        at(3).alias("master_id"),
        whole(4).alias("ping_sent"),
        whole(5).alias("pong_received"),
        whole(6).alias("config_epoch"),
        at(7).alias("link_state"),
        F.transform(
            plain,
            lambda s: F.struct(
                F.substring_index(s, "-", 1).cast("bigint").alias("start"),
                F.substring_index(s, "-", -1).cast("bigint").alias("end"),
            ),
        ).alias("ranges"),
        marked("->-").alias("migrating"),
        marked("-<-").alias("importing"),
    )


_SHARD = (
    "array<struct<slots:array<bigint>, nodes:array<struct<id:string, role:string, endpoint:string, ip:string, "
    "hostname:string, port:bigint, `tls-port`:bigint, health:string, `replication-offset`:bigint>>>>"
)


def cluster_shards_rows(dumps: DataFrame, column: str = "text") -> DataFrame:
    """One row per shard node from a JSON reply of shard maps; nodes without an id are skipped."""
    others = [c for c in dumps.columns if c != column]
    shards = dumps.select(*others, F.posexplode(F.from_json(column, _SHARD)).alias("shard_no", "_s"))
    ranges = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.size("_s.slots") / 2).cast("int") - 1, F.lit(0))),
        lambda i: F.named_struct(
            F.lit("start"), F.get(F.col("_s.slots"), i * 2), F.lit("end"), F.get(F.col("_s.slots"), i * 2 + 1)
        ),
    )
    return (
        shards.select(*others, F.col("shard_no").cast("bigint").alias("shard_no"), F.filter(ranges, lambda r: r["end"].isNotNull()).alias("ranges"), F.explode("_s.nodes").alias("n"))
        .where(F.col("n.id") != "")
        .select(
            *others,
            "shard_no",
            "ranges",
            F.col("n.id").alias("node_id"),
            F.coalesce("n.role", F.lit("unknown")).alias("role"),
            F.coalesce("n.endpoint", "n.ip").alias("endpoint"),
            F.col("n.hostname").alias("hostname"),
            F.coalesce("n.port", "n.`tls-port`").alias("port"),
            F.col("n.health").alias("health"),
            F.col("n.`replication-offset`").alias("replication_offset"),
        )
    )


def slot_stats_rows(dumps: DataFrame, column: str = "text") -> DataFrame:
    """(…, slot, key_count, expires_count, total_reads, total_writes) from ``[[slot, [metric, value]], …]``."""
    others = [c for c in dumps.columns if c != column]
    entries = dumps.select(*others, F.explode(F.from_json(column, "array<string>")).alias("_e")).withColumn(
        "_e", F.from_json("_e", "array<string>")
    )
    parts = entries.select(
        *others, F.get("_e", F.lit(0)).try_cast("bigint").alias("slot"), F.from_json(F.get("_e", F.lit(1)), "array<string>").alias("_m")
    ).where(F.col("slot").isNotNull())
    metric, value = F.lower(F.get("_m", F.lit(0))), F.get("_m", F.lit(1)).try_cast("bigint")
    pick = lambda name: F.coalesce(F.max(F.when(metric == name, value)), F.lit(0))
    return parts.groupBy(*others, "slot").agg(
        pick("key-count").alias("key_count"),
        pick("expires-count").alias("expires_count"),
        pick("total-reads").alias("total_reads"),
        pick("total-writes").alias("total_writes"),
    )


def acl_log_rows(dumps: DataFrame, column: str = "text") -> DataFrame:
    """Access-denial entries from JSON lists of flat field/value lists."""
    others = [c for c in dumps.columns if c != column]
    entries = dumps.select(*others, F.explode(F.from_json(column, "array<array<string>>")).alias("_e"))
    get = lambda k: F.try_element_at(
        "_e", (F.nullif(F.array_position("_e", k), F.lit(0)) + 1).cast("int")
    )
    return entries.select(
        *others,
        get("count").try_cast("bigint").alias("count"),
        get("reason").alias("reason"),
        get("context").alias("context"),
        get("object").alias("object"),
        get("username").alias("username"),
        get("age-seconds").try_cast("double").alias("age_seconds"),
        get("client-info").alias("client_info"),
        get("timestamp-created").try_cast("bigint").alias("created_ms"),
        get("timestamp-last-updated").try_cast("bigint").alias("updated_ms"),
    )
