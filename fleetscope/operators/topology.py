"""Fleet state: nodes, indexes, instances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.operators.keyspace import js_round


def node_imbalance(nodes: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Nodes whose memory, ops or clients are off their group's mean by more than the tolerance."""
    gauges = ("memory", "ops", "clients")
    means = nodes.groupBy("grp").agg(*[F.avg(g).alias(f"_{g}") for g in gauges])

    def off(gauge: str):
        mean = F.col(f"_{gauge}")
        return F.abs(F.col(gauge) - mean) / F.when(mean == 0, 1.0).otherwise(mean) > tolerance

    flags = nodes.join(means, "grp").select("grp", "node_id", *[off(g).alias(f"{g}_off") for g in gauges])
    return flags.where(F.col("memory_off") | F.col("ops_off") | F.col("clients_off"))


def vector_fleet_totals(indexes: DataFrame) -> DataFrame:
    return indexes.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("indexes"),
        F.sum("num_docs").alias("docs"),
        F.sum("memory_bytes").alias("memory_bytes"),
        F.count_if(F.col("percent_indexed") < 100).alias("building"),
        F.count_if(F.col("failures") > 0).alias("failing"),
    )


def baseline_comparison(
    readings: DataFrame,
    migrated_ms: int,
    limits: Mapping[str, tuple[float, float]],
    min_snapshots: int = 5,
) -> DataFrame:
    """Mean reading before a migration against the newest one, per connection and metric.

    ``limits`` maps a metric to its (elevated above, degraded below) percent bounds.
    """
    keys = ["connection_id", "metric"]
    before = readings.where(F.col("ts_ms") < migrated_ms).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("snapshots"), F.avg("reading").alias("_base")
    )
    current = readings.groupBy(*keys).agg(
        F.max_by("reading", F.struct("ts_ms", "id")).cast("double").alias("_cur")
    )
    base, cur = F.col("_base"), F.col("_cur")
    delta = (cur - base) / base * 100
    usable = (F.col("snapshots") >= min_snapshots) & (base != 0)
    bounds = F.create_map(
        *[x for m, (hi, lo) in limits.items() for x in (F.lit(m), F.struct(F.lit(hi).alias("hi"), F.lit(lo).alias("lo")))]
    )[F.col("metric")]
    return before.join(current, keys).select(
        *keys,
        "snapshots",
        F.when(F.col("snapshots") >= min_snapshots, js_round(base * 100) / 100).alias("baseline"),
        (js_round(cur * 100) / 100).alias("current_value"),
        F.when(usable, js_round(delta * 100) / 100).alias("delta_pct"),
        F.when(~usable, "unavailable")
        .when(delta > bounds["hi"], "elevated")
        .when(delta < bounds["lo"], "degraded")
        .otherwise("normal")
        .alias("status"),
    )


# Flags of a node that is not a stable, reachable member.
UNHEALTHY_FLAGS = ("fail", "fail?", "handshake", "noaddr")
GHOST_FLAGS = ("fail", "fail?", "noaddr")
SLOT_BUCKET = 256


def _any_flag(flags: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col("flags"), F.array(*[F.lit(f) for f in flags]))


def _has(flag: str) -> Column:
    return F.array_contains("flags", flag)


def _is_replica() -> Column:
    named = F.coalesce(F.col("master_id"), F.lit("")).isin("", "-")
    return (_has("slave") | _has("replica")) & ~named


def duplicate_primaries(nodes: DataFrame) -> DataFrame:
    """Pairs of live primaries claiming the same slots; the lower config epoch is the phantom.

    ``nodes`` has (cluster, node_id, config_epoch, flags, ranges array of (start, end)). Ranges
    are cut into fixed slot buckets, so only ranges of one bucket meet; a pair is kept in the
    bucket that holds its first common slot.
    """
    live = nodes.where(_has("master") & ~_any_flag(UNHEALTHY_FLAGS)).select(
        "cluster", "node_id", "config_epoch", F.explode("ranges").alias("r")
    )
    bucket = F.explode(
        F.sequence(F.floor(F.col("r.start") / SLOT_BUCKET), F.floor(F.col("r.end") / SLOT_BUCKET))
    )
    cut = live.select(
        "cluster",
        "node_id",
        "config_epoch",
        F.col("r.start").alias("start"),
        F.col("r.end").alias("end"),
        bucket.alias("bucket"),
    )
    a, b = cut.alias("a"), cut.alias("b")
    first = F.greatest("a.start", "b.start")
    pairs = a.join(
        b,
        (F.col("a.cluster") == F.col("b.cluster"))
        & (F.col("a.bucket") == F.col("b.bucket"))
        & (F.col("a.node_id") < F.col("b.node_id"))
        & (F.col("a.start") <= F.col("b.end"))
        & (F.col("b.start") <= F.col("a.end")),
    ).where(F.floor(first / SLOT_BUCKET) == F.col("a.bucket"))
    phantom = F.when(F.col("b.config_epoch") > F.col("a.config_epoch"), F.col("a.node_id")).otherwise(
        F.col("b.node_id")
    )
    overlap = F.struct(first.alias("s"), F.least("a.end", "b.end").alias("e"))
    return (
        pairs.groupBy(
            F.col("a.cluster").alias("cluster"),
            F.col("a.node_id").alias("node_a"),
            F.col("b.node_id").alias("node_b"),
            phantom.alias("phantom"),
        )
        .agg(F.min(overlap).alias("o"))
        .select("cluster", "node_a", "node_b", "phantom", F.col("o.s").alias("slot_start"), F.col("o.e").alias("slot_end"))
    )


def stuck_replicas(nodes: DataFrame) -> DataFrame:
    """Replicas whose primary is dead or unknown. (cluster, node_id, master_id, flags)."""
    primaries = nodes.select(
        "cluster",
        F.col("node_id").alias("master_id"),
        (_has("master") & ~_any_flag(UNHEALTHY_FLAGS)).alias("_healthy"),
    )
    return (
        nodes.where(_is_replica())
        .join(primaries, ["cluster", "master_id"], "left")
        .where(~F.coalesce("_healthy", F.lit(False)))
        .select(
            "cluster",
            "node_id",
            "master_id",
            F.when(F.col("_healthy").isNull(), "primary_unknown").otherwise("primary_failed").alias("reason"),
        )
    )


def hostname_staleness(nodes: DataFrame, shards: DataFrame) -> DataFrame:
    """Nodes without a hostname where peers have one, and hostnames that differ between the views.

    ``nodes`` has (cluster, node_id, hostname, flags); ``shards`` (cluster, node_id, hostname).
    """
    known = nodes.where((F.col("node_id") != "") & ~_any_flag(UNHEALTHY_FLAGS)).withColumn(
        "hostname", F.coalesce("hostname", F.lit(""))
    )
    named = known.groupBy("cluster").agg(F.bool_or(F.col("hostname") != "").alias("_any"))
    missing = known.where(F.col("hostname") == "").join(named.where("_any"), "cluster", "left_semi")
    other = shards.where(F.col("hostname") != "").select("cluster", "node_id", F.col("hostname").alias("_other"))
    differing = (
        known.where(F.col("hostname") != "")
        .join(other, ["cluster", "node_id"])
        .where(F.col("hostname") != F.col("_other"))
    )
    return missing.select("cluster", "node_id", F.lit("missing_hostname").alias("reason")).unionByName(
        differing.select("cluster", "node_id", F.lit("hostname_mismatch").alias("reason"))
    )


def replica_slot_state(nodes: DataFrame, shards: DataFrame) -> DataFrame:
    """Replicas reporting slot state they should not have, unless the shard view calls them masters.

    ``nodes`` has (cluster, node_id, master_id, flags, ranges, migrating, importing); ``shards``
    (cluster, node_id, role, shard_id).
    """
    view = shards.select("cluster", "node_id", "role", "shard_id", F.lit(True).alias("_seen"))
    has_view = shards.select("cluster").distinct().withColumn("_view", F.lit(True))
    rows = (
        nodes.where(_is_replica())
        .join(view, ["cluster", "node_id"], "left")
        .join(has_view, "cluster", "left")
        .where(~F.coalesce(F.col("role") == "master", F.lit(False)))
    )
    moving, coming = F.size("migrating") > 0, F.size("importing") > 0
    diverging = F.coalesce("_view", F.lit(False)) & ~moving & ~coming & (F.size("ranges") > 0)
    bounds = F.flatten(F.transform("ranges", lambda r: F.array(r["start"], r["end"])))
    finding = lambda cond, reason, slots: F.when(
        cond, F.struct(F.lit(reason).alias("reason"), F.array_sort(F.array_distinct(slots)).alias("slots"))
    )
    found = F.array_compact(
        F.array(
            finding(moving, "replica_migrating", F.col("migrating")),
            finding(coming, "replica_importing", F.col("importing")),
            finding(diverging, "slot_view_divergence", bounds),
        )
    )
    return rows.select("cluster", "node_id", "shard_id", F.explode(found).alias("f")).select(
        "cluster", "node_id", "shard_id", "f.reason", F.concat_ws(",", F.col("f.slots").cast("array<string>")).alias("slots")
    )


def lagging_promotion(promotions: DataFrame, peers: DataFrame, min_gap_bytes: int) -> DataFrame:
    """Promoted replicas that were behind a sibling. (node_id, replid, offset) and (node_id, replid, role, offset)."""
    siblings = peers.where(F.col("role").isin("slave", "replica") & F.col("offset").isNotNull()).select(
        "replid", F.col("node_id").alias("peer_id"), F.col("offset").alias("peer_offset")
    )
    # Two best siblings suffice: the promoted node itself may be one of them.
    rank = F.row_number().over(Window.partitionBy("replid").orderBy(F.desc("peer_offset"), "peer_id"))
    best = siblings.withColumn("_rn", rank).where(F.col("_rn") <= 2).drop("_rn")
    joined = promotions.join(best, "replid").where(F.col("peer_id") != F.col("node_id"))
    ahead = joined.groupBy("node_id", "replid", "offset").agg(
        F.max_by(F.struct("peer_id", "peer_offset"), F.struct(F.col("peer_offset"))).alias("p")
    )
    lag = F.col("p.peer_offset") - F.col("offset")
    return ahead.where(lag >= min_gap_bytes).select(
        "node_id", "replid", F.col("p.peer_id").alias("ahead_id"), lag.alias("lag_bytes")
    )


def replication_lag(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Lag of each replica behind its master.

    ``nodes`` has (cluster, node_id, master_id, flags, link_state); ``stats`` (cluster, node_id,
    offset, last_io_s, link).
    """
    masters = nodes.select("cluster", F.col("node_id").alias("master_id"))
    own = stats.select(
        "cluster", "node_id", F.coalesce("offset", F.lit(0)).alias("_o"), F.coalesce("last_io_s", F.lit(0)).alias("_io"), F.col("link").alias("_link"), F.lit(True).alias("_own")
    )
    theirs = stats.select(
        "cluster", F.col("node_id").alias("master_id"), F.coalesce("offset", F.lit(0)).alias("_mo"), F.lit(True).alias("_theirs")
    )
    joined = (
        nodes.where(_is_replica())
        .join(masters, ["cluster", "master_id"])
        .join(own, ["cluster", "node_id"], "left")
        .join(theirs, ["cluster", "master_id"], "left")
    )
    detailed = F.col("_own").isNotNull() & F.col("_theirs").isNotNull()
    diff = F.when(detailed, F.col("_mo") - F.col("_o")).otherwise(F.lit(0))
    lag_ms = F.when(detailed, F.col("_io") * 1000).otherwise(F.lit(0))
    healthy = (F.col("link_state") == "connected") & ~_has("fail")
    up = F.when(detailed, F.coalesce(F.col("_link") == "up", F.lit(False))).otherwise(healthy)
    return joined.select(
        "cluster",
        "node_id",
        "master_id",
        diff.cast("bigint").alias("offset_diff"),
        lag_ms.cast("bigint").alias("lag_ms"),
        F.when(~up, "disconnected")
        .when(diff == 0, "in-sync")
        .when((diff < 1000) & (lag_ms < 100), "slight-lag")
        .otherwise("lagging")
        .alias("status"),
    )


def config_drift(settings: DataFrame) -> DataFrame:
    """Keys on which members of a group differ. (grp, node_id, name, value or null)."""
    return (
        settings.where(F.col("value").isNotNull())
        .groupBy("grp", "name")
        .agg(
            F.count(F.lit(1)).alias("reporters"),
            F.countDistinct("value").alias("distinct_values"),
        )
        .where((F.col("reporters") >= 2) & (F.col("distinct_values") > 1))
    )


def acl_user_digest(line: Column) -> Column:
    """First 16 hex digits of the SHA-256 over a user and their sorted, normalised rules."""
    tokens = F.regexp_extract_all(line, F.lit(r"((?:\([^)]*\)|[^\s()])+)"), F.lit(1))
    rules = F.slice(tokens, 3, F.greatest(F.size(tokens) - 2, F.lit(0)))

    def normal(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token) - 2)
        parts = F.filter(F.split(inner, r"\s+"), lambda p: p != "")
        selector = F.concat(F.lit("("), F.array_join(F.array_sort(parts), " "), F.lit(")"))
        return F.when(token.startswith("(") & token.endswith(")"), selector).otherwise(token)

    text = F.array_join(F.array_sort(F.transform(rules, normal)), " ")
    parsed = (F.size(tokens) >= 2) & (F.lower(F.get(tokens, F.lit(0))) == "user")
    digest = F.substring(F.sha2(F.concat(F.get(tokens, F.lit(1)), F.lit("\n"), text), 256), 1, 16)
    return F.when(parsed, F.struct(F.get(tokens, F.lit(1)).alias("username"), digest.alias("digest")))


def acl_digests(acl: DataFrame) -> DataFrame:
    """(grp, node_id, username, digest) from ACL list lines; unreadable lines are skipped."""
    return (
        acl.withColumn("_d", acl_user_digest(F.col("line")))
        .where(F.col("_d").isNotNull())
        .select("grp", "node_id", "_d.username", "_d.digest")
    )


def acl_node_digest(digests: DataFrame) -> DataFrame:
    """Exclusive-or of the user digests of each node, independent of line order."""
    half = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("bigint")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return digests.groupBy("grp", "node_id").agg(
        F.concat(text(F.bit_xor(half(1))), text(F.bit_xor(half(9)))).alias("node_digest")
    )


def acl_drift(digests: DataFrame) -> DataFrame:
    """Users on which members of a group disagree; a user missing on a member counts as different."""
    nodes = (
        acl_node_digest(digests)
        .groupBy("grp")
        .agg(F.count(F.lit(1)).alias("_nodes"), F.countDistinct("node_digest").alias("_digests"))
        .where((F.col("_nodes") >= 2) & (F.col("_digests") > 1))
    )
    users = digests.groupBy("grp", "username").agg(
        F.countDistinct("node_id").alias("present_on"), F.countDistinct("digest").alias("variants")
    )
    return (
        users.join(nodes, "grp")
        .where((F.col("variants") > 1) | (F.col("present_on") < F.col("_nodes")))
        .select("grp", "username", "present_on", "variants")
    )


def canonical_endpoint(address: Column) -> Column:
    host_port = F.substring_index(F.coalesce(address, F.lit("")), "@", 1)
    host = F.when(host_port.contains(":"), F.regexp_extract(host_port, r"^(.*):[^:]*$", 1)).otherwise(host_port)
    return F.when(host != "", host_port)


def endpoint_host(endpoint: Column) -> Column:
    host = F.when(endpoint.contains(":"), F.regexp_extract(endpoint, r"^(.*):[^:]*$", 1)).otherwise(endpoint)
    return F.regexp_replace(F.regexp_replace(host, r"^\[", ""), r"\]$", "")


def is_loopback(host: Column) -> Column:
    return F.lower(host).isin("localhost", "::1") | host.rlike(r"^127\.")


def ghost_members(nodes: DataFrame) -> DataFrame:
    """Endpoints claimed by more than one member record, and lone loopback addresses.

    ``nodes`` has (cluster, node_id, address, master_id, flags).
    """
    ghost = _any_flag(GHOST_FLAGS)
    placed = nodes.withColumn("endpoint", canonical_endpoint(F.col("address"))).where(
        F.col("endpoint").isNotNull()
    )
    loop = is_loopback(endpoint_host(F.col("endpoint")))
    counted = ~_has("handshake") & ~_has("fail") & ~_has("noaddr")
    nid = F.col("node_id")
    established = ~ghost & ~_has("handshake")
    per = placed.groupBy("cluster", "endpoint").agg(
        F.max(loop.cast("int")).alias("_loop"),
        F.bool_or(counted).alias("_counted"),
        F.min(F.when(~ghost, nid)).alias("_live"),
        F.min(F.when(established, nid)).alias("_est"),
        F.countDistinct(F.when(established, nid)).alias("_est_n"),
        F.array_sort(F.collect_set(F.when(ghost, nid))).alias("_ghosts"),
        F.array_sort(F.collect_set(F.when(~ghost, nid))).alias("_lives"),
        F.array_sort(F.collect_set(F.when(established, nid))).alias("_ests"),
        F.array_sort(
            F.collect_set(F.when((nid == F.col("master_id")), nid))
        ).alias("_self"),
    )
    census = per.groupBy("cluster").agg(
        F.count_if(F.col("_counted") & (F.col("_loop") == 1)).alias("_loops"),
        F.count_if(F.col("_counted") & (F.col("_loop") == 0)).alias("_routed"),
    )
    rows = per.join(census, "cluster")
    occupant = F.coalesce("_est", "_live")
    flip = (F.col("_routed") > F.col("_loops")) & (F.col("_loop") == 1) & F.col("_live").isNotNull()
    collision = ~flip & (F.col("_est_n") >= 2)
    twins = F.filter("_ghosts", lambda g: g != occupant)
    stale = F.col("_live").isNotNull() & (F.size(twins) > 0)
    finding = lambda cond, reason, ids: F.when(
        cond, F.struct(F.lit(reason).alias("reason"), ids.alias("ids"))
    )
    found = F.array_compact(
        F.array(
            finding(flip, "loopback_flip", F.col("_lives")),
            finding(collision, "live_endpoint_collision", F.col("_ests")),
            finding(stale, "stale_twin", twins),
        )
    )
    return rows.select("cluster", "endpoint", occupant.alias("occupant"), "_self", F.explode(found).alias("f")).select(
        "cluster",
        "endpoint",
        "occupant",
        "f.reason",
        F.array_join("f.ids", ",").alias("ids"),
        F.array_join(
            F.array_intersect("_self", F.array_union(F.col("f.ids"), F.array("occupant"))), ","
        ).alias("self_replicating"),
    )


def is_ip_literal(host: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(host), r"^\[", ""), r"\]$", "")
    return (bare != "") & (bare.contains(":") | bare.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"))


def is_hostname(host: Column) -> Column:
    bare = F.trim(host)
    return ~bare.isin("", "?") & ~is_ip_literal(host) & bare.rlike("(?i)[a-z]")


def sentinel_drift(members: DataFrame) -> DataFrame:
    """Sentinel records that fell back to raw addresses, point to themselves or to stale masters.

    ``members`` has (master_name, node_name, role, ip, port, master_host, master_port).
    """
    ip, target = F.coalesce("ip", F.lit("")), F.coalesce("master_host", F.lit(""))
    replica = F.col("role") == "replica"
    uses = members.groupBy("master_name").agg(
        F.bool_or(is_hostname(ip)).alias("_names"),
        F.bool_or(replica & is_hostname(target)).alias("_pointer_names"),
    )
    rows = members.join(uses, "master_name")
    own = F.concat_ws(":", ip, F.col("port").cast("string"))
    pointed = F.concat_ws(":", target, F.col("master_port").cast("string"))
    itself = (
        replica & (target != "") & (F.col("master_port") == F.col("port")) & (target == ip)
    )
    finding = lambda cond, reason, endpoint: F.when(
        cond, F.struct(F.lit(reason).alias("reason"), endpoint.alias("endpoint"))
    )
    found = F.array_compact(
        F.array(
            finding(itself, "self_replication", own),
            finding(F.col("_names") & is_ip_literal(ip), "ip_for_hostname", own),
            finding(
                F.col("_names") & F.col("_pointer_names") & replica & is_ip_literal(target),
                "stale_master_pointer",
                pointed,
            ),
        )
    )
    return rows.select("master_name", "node_name", "role", F.explode(found).alias("f")).select(
        "master_name", "node_name", "role", "f.reason", "f.endpoint"
    )


def orphaned_slot_keys(sizes: DataFrame, slots: DataFrame, min_keys: int = 100) -> DataFrame:
    """Primaries holding keys no slot accounts for; nodes importing slots are a gap, not a finding.

    ``sizes`` has (node_id, dbsize, importing), several reads per node; ``slots`` (node_id, slot, key_count).
    """
    low = sizes.groupBy("node_id").agg(F.min("dbsize").alias("dbsize"), F.bool_or("importing").alias("_importing"))
    counted = slots.where(F.col("key_count") > 0).groupBy("node_id").agg(F.sum("key_count").alias("slot_keys"))
    orphaned = F.col("dbsize") - F.coalesce("slot_keys", F.lit(0))
    return (
        low.where(~F.col("_importing"))
        .join(counted, "node_id", "left")
        .withColumn("orphaned", orphaned)
        .where(F.col("orphaned") >= min_keys)
        .select("node_id", "dbsize", "orphaned")
    )


def at_least_version(version: Column, major: int, minor: int) -> Column:
    part = lambda n: F.coalesce(F.get(F.split(version, r"\."), F.lit(n)).try_cast("int"), F.lit(0))
    return (part(0) > major) | ((part(0) == major) & (part(1) >= minor))


def compatibility_report(migrations: DataFrame, instances: DataFrame) -> DataFrame:
    """Rules a planned migration breaks, with severity.

    ``migrations`` has (source_id, target_id, hfe, functions); ``instances`` (instance_id, engine,
    version, modules, clustered, multi_db, policy, acl_users, persistence).
    """
    columns = ("engine", "version", "modules", "clustered", "multi_db", "policy", "acl_users", "persistence")
    side = lambda p: instances.select(
        F.col("instance_id").alias(f"{p}_id"), F.struct(*columns).alias(p)
    )
    pairs = migrations.join(side("source"), "source_id").join(side("target"), "target_id")
    s, t = (lambda c: F.col(f"source.{c}")), (lambda c: F.col(f"target.{c}"))
    crossing = (s("engine") == "valkey") & (t("engine") == "redis")
    rule = lambda cond, severity, category, detail="": F.when(
        cond,
        F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(detail).alias("detail")),
    )
    fixed = F.array(
        rule(crossing, "blocking", "type_direction"),
        rule(F.col("functions") & crossing, "warning", "functions", "excluded"),
        rule(F.col("functions") & ~crossing, "warning", "functions", "sync_only"),
        rule(
            F.col("hfe") & ~((t("engine") == "valkey") & at_least_version(t("version"), 8, 1)), "blocking", "hfe"
        ),
        rule(s("clustered") & ~t("clustered"), "blocking", "cluster_topology"),
        rule(~s("clustered") & t("clustered"), "warning", "cluster_topology"),
        rule(s("multi_db") & t("clustered"), "blocking", "multi_db"),
        rule(s("multi_db") & ~t("clustered") & ~t("multi_db"), "warning", "multi_db"),
        rule(s("policy") != t("policy"), "warning", "maxmemory_policy"),
        rule(s("acl_users") & ~t("acl_users"), "warning", "acl"),
        rule(s("persistence") != t("persistence"), "info", "persistence"),
    )
    missing = F.transform(
        F.array_except(s("modules"), t("modules")),
        lambda m: F.struct(
            F.lit("blocking").alias("severity"), F.lit("modules").alias("category"), m.alias("detail")
        ),
    )
    return pairs.select(
        "source_id", "target_id", F.explode(F.concat(F.array_compact(fixed), missing)).alias("i")
    ).select("source_id", "target_id", "i.*")


def slot_migrations(node_lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Slots on the move, from the markers of each node line, joined to peers by id prefix.

    ``node_lines`` has (cluster, node_id, slots_text); ``nodes`` (cluster, node_id). Prefixes of one
    cluster have few lengths: the peers' ids are cut to those lengths and equi-joined.
    """
    found = node_lines.select(
        "cluster",
        "node_id",
        F.explode(
            F.regexp_extract_all("slots_text", F.lit(r"(\[\d+(?:->-|-<-)[A-Fa-f0-9]+\])"), F.lit(1))
        ).alias("m"),
    ).select(
        "cluster",
        "node_id",
        F.regexp_extract("m", r"\[(\d+)", 1).cast("bigint").alias("slot"),
        F.when(F.col("m").contains("->-"), "migrating").otherwise("importing").alias("state"),
        F.regexp_extract("m", r"(?:->-|-<-)([A-Fa-f0-9]+)\]", 1).alias("prefix"),
    )
    lengths = found.select("cluster", F.length("prefix").alias("len")).distinct()
    cut = nodes.join(lengths, "cluster").select(
        "cluster", F.col("node_id").alias("peer"), F.expr("substring(node_id, 1, len)").alias("prefix")
    )
    peers = cut.groupBy("cluster", "prefix").agg(F.min("peer").alias("peer"))
    moving = F.col("state") == "migrating"
    return found.join(peers, ["cluster", "prefix"]).select(
        "cluster",
        "slot",
        "state",
        F.when(moving, F.col("node_id")).otherwise(F.col("peer")).alias("source_id"),
        F.when(moving, F.col("peer")).otherwise(F.col("node_id")).alias("target_id"),
    )


def instance_health(info: DataFrame) -> DataFrame:
    """Hit rate, fragmentation, clients, lag and key total from dump rows.

    ``info`` has (connection_id, section, name, value). A missing keyspace section gives null,
    an empty one zero.
    """
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    number = lambda name: F.coalesce(pick(name).try_cast("double"), F.lit(0.0))
    keys = F.regexp_extract("value", r"(?:^|,)keys=(\d+)", 1).try_cast("bigint")
    is_db = (F.lower("section") == "keyspace") & F.col("name").rlike(r"^db\d+$")
    wide = info.groupBy("connection_id").agg(
        number("keyspace_hits").alias("_hits"),
        number("keyspace_misses").alias("_misses"),
        number("mem_fragmentation_ratio").alias("fragmentation"),
        number("connected_clients").alias("clients"),
        F.coalesce(pick("role"), F.lit("unknown")).alias("role"),
        F.coalesce(pick("master_last_io_seconds_ago").try_cast("double"), F.lit(-1.0)).alias("_io"),
        F.bool_or(F.lower("section") == "keyspace").alias("_has_keyspace"),
        F.coalesce(F.sum(F.when(is_db, keys)), F.lit(0)).alias("_keys"),
    )
    lookups = F.col("_hits") + F.col("_misses")
    return wide.select(
        "connection_id",
        F.when(lookups > 0, F.col("_hits") / lookups).alias("hit_rate"),
        "fragmentation",
        "clients",
        "role",
        F.when(F.col("role").isin("slave", "replica") & (F.col("_io") >= 0), F.col("_io")).alias("replication_lag_s"),
        F.when(F.col("_has_keyspace"), F.col("_keys")).alias("keyspace_keys"),
    )
