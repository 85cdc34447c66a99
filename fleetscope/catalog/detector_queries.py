"""Detector, correlation and episode queries."""

from pyspark.sql import functions as F

from fleetscope.catalog import walks
from fleetscope.catalog.registry import query
from fleetscope.catalog.series_queries import BASELINE
from fleetscope.catalog.views import ORIGIN_MS, Tables
from fleetscope.operators import latency
from fleetscope.streaming import detectors as D

HOUR, DAY = 3_600_000, 86_400_000


@query("spike_events", "T1", walks.spikes(BASELINE, 2, 6 * HOUR))
def _spikes(t: Tables):
    return D.spike_events(t.metric, D.SpikeConfig(consecutive=2, cooldown_ms=6 * HOUR), slice_ms=DAY)


@query(
    "loud_metric_rows",
    "T1 W5",
    f"""WITH {BASELINE}, z AS (SELECT *, CASE WHEN stddev = 0 THEN 0 ELSE (cents-mean)/stddev END AS z FROM b WHERE ready)
    SELECT connection_id, metric, ts_ms, id, CASE WHEN cents >= 30000 THEN 'critical' WHEN abs(z) >= 3 THEN 'critical' WHEN abs(z) >= 2 THEN 'warning' END AS severity FROM z WHERE z >= 0""",
)
def _loud(t: Tables):
    rows = D.loud_rows(t.metric, D.SpikeConfig(critical_value=300.0), slice_ms=DAY)
    return rows.select("connection_id", "metric", "ts_ms", "id", "severity")


METRICS = ("connections", "ops_per_sec", "memory_used", "evicted_keys", "acl_denied")


def anomalies(t: Tables):
    names = F.create_map(*[F.lit(x) for pair in zip(("click", "view", "purchase", "signup", "error"), METRICS) for x in pair])
    return t.metric.select(
        "connection_id", "ts_ms", "id", names[F.col("metric")].alias("metric"),
        F.when(F.col("id") % 3 == 0, "drop").otherwise("spike").alias("anomaly_type"),
        F.when(F.col("value") > 100, "critical").when(F.col("value") > 50, "warning").otherwise("info").alias("severity"),
        F.lit(False).alias("saturated"),
    )


_EVENTS = """e AS (SELECT connection_id, ts_ms, id, CASE metric WHEN 'click' THEN 'connections' WHEN 'view' THEN 'ops_per_sec' WHEN 'purchase' THEN 'memory_used' WHEN 'signup' THEN 'evicted_keys' ELSE 'acl_denied' END AS metric,
  CASE WHEN id % 3 = 0 THEN 'drop' ELSE 'spike' END AS kind, CASE WHEN value > 100 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END AS lvl FROM v_metric),
  f AS (SELECT connection_id, min(ts_ms) AS s FROM e GROUP BY 1),
  a AS (SELECT connection_id, s FROM f UNION ALL SELECT a.connection_id, (SELECT min(e.ts_ms) FROM e WHERE e.connection_id = a.connection_id AND e.ts_ms > a.s + 7200000) FROM a
    WHERE EXISTS (SELECT 1 FROM e WHERE e.connection_id = a.connection_id AND e.ts_ms > a.s + 7200000)),
  g AS (SELECT a.connection_id, a.s AS start_ms, arg_min(e.id, (e.ts_ms, e.id)) AS head_id, max(ts_ms) AS end_ms, count(*) AS n, max(lvl) AS lvl, list(DISTINCT metric) AS m, coalesce(list(DISTINCT metric) FILTER (kind = 'spike'), []) AS sp,
    arg_min(kind, (ts_ms, id)) FILTER (metric = 'connections') AS fc FROM a JOIN e ON e.connection_id = a.connection_id AND e.ts_ms BETWEEN a.s AND a.s + 7200000 GROUP BY 1,2)"""


@query(
    "correlated_anomalies",
    "T2",
    f"""WITH RECURSIVE {_EVENTS}
    SELECT connection_id, start_ms, head_id, end_ms, n, array_to_string(list_sort(m), ',') AS metrics, CASE WHEN list_contains(m, 'acl_denied') THEN 'auth_attack'
      WHEN list_contains(sp, 'memory_used') AND (list_contains(m, 'evicted_keys') OR n = 1) THEN 'memory_pressure' WHEN fc = 'spike' AND NOT list_contains(m, 'ops_per_sec') THEN 'connection_leak'
      WHEN list_contains(sp, 'connections') AND list_contains(sp, 'ops_per_sec') AND list_contains(sp, 'memory_used') THEN 'batch_job' WHEN list_contains(sp, 'connections') AND list_contains(sp, 'ops_per_sec') AND NOT list_contains(sp, 'memory_used') THEN 'traffic_burst'
      WHEN list_contains(m, 'ops_per_sec') THEN 'traffic_burst' WHEN list_contains(m, 'evicted_keys') THEN 'memory_pressure' WHEN list_contains(m, 'connections') THEN 'connection_leak' ELSE 'unknown' END AS pattern,
      CASE lvl WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM g""",
)
def _correlated(t: Tables):
    return D.correlate(anomalies(t), 2 * HOUR)


@query(
    "threshold_alerts",
    "T3",
    """WITH s AS (SELECT s_name AS subscriber, CASE WHEN s_suppkey % 2 = 0 THEN CAST(200 + s_suppkey AS DOUBLE) END AS threshold, s_suppkey % 3 <> 2 AS above FROM supplier),
      r AS (SELECT subscriber, connection_id, 'memory_critical' AS alert, ts_ms, id, value, coalesce(threshold, 90) AS lim, above FROM v_metric, s WHERE metric = 'click'),
      k AS (SELECT *, CASE WHEN CASE WHEN above THEN value >= lim ELSE value <= lim END THEN 1 WHEN CASE WHEN above THEN value < lim*CAST(0.9 AS DOUBLE) ELSE value > lim*(2-CAST(0.9 AS DOUBLE)) END THEN 0 END AS mk FROM r),
      l AS (SELECT *, lag(mk) OVER (PARTITION BY subscriber, connection_id ORDER BY ts_ms, id) AS b FROM k WHERE mk IS NOT NULL)
    SELECT subscriber, connection_id, alert, ts_ms, id, value, lim AS limit_value FROM l WHERE mk = 1 AND coalesce(b, 0) = 0""",
)
def _alerts(t: Tables):
    key = F.col("s_suppkey")
    subscribers = t.table("supplier").select(
        F.col("s_name").alias("subscriber"), F.lit("memory_critical").alias("alert"),
        F.when(key % 2 == 0, (key + 200).cast("double")).alias("threshold"), (key % 3 != 2).alias("above"),
    )
    readings = t.metric.where(F.col("metric") == "click").select(
        "connection_id", F.lit("memory_critical").alias("alert"), "ts_ms", "id", "value"
    )
    return D.threshold_alerts(readings, subscribers)


_ALERT_OF = {"view": "memory_critical", "signup": "connection_critical", "click": "compliance_memory", "error": "slowlog_count", "purchase": "replication_lag_seconds"}
_ALERTS = list(_ALERT_OF.values())
_ALERT_SQL = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ALERT_OF.items()) + " END"
_DEFAULT_SQL = "CASE alert " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.ALERT_DEFAULTS.items()) + " END"


@query(
    "threshold_alerts_by_kind",
    "T3",
    f"""WITH s AS (SELECT s_name AS subscriber, CASE s_suppkey % 5 {" ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ALERTS))} END AS alert,
        CASE WHEN s_suppkey % 4 <> 0 THEN CAST(200 + s_suppkey AS DOUBLE) END AS threshold, s_suppkey % 3 <> 2 AS above FROM supplier),
      l AS (SELECT *, coalesce(threshold, CAST({_DEFAULT_SQL} AS DOUBLE)) AS lim FROM s),
      m AS (SELECT connection_id, {_ALERT_SQL} AS alert, ts_ms, id, value FROM v_metric),
      k AS (SELECT *, CASE WHEN CASE WHEN above THEN value >= lim ELSE value <= lim END THEN 1 WHEN CASE WHEN above THEN value < lim*CAST(0.9 AS DOUBLE) ELSE value > lim*(2-CAST(0.9 AS DOUBLE)) END THEN 0 END AS mk FROM m JOIN l USING (alert)),
      b AS (SELECT *, lag(mk) OVER (PARTITION BY subscriber, connection_id ORDER BY ts_ms, id) AS b FROM k WHERE mk IS NOT NULL)
    SELECT subscriber, connection_id, alert, ts_ms, id, value, lim AS limit_value FROM b WHERE mk = 1 AND coalesce(b, 0) = 0""",
)
def _alerts_by_kind(t: Tables):
    key = F.col("s_suppkey")
    name = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), at)
    subscribers = t.table("supplier").select(
        F.col("s_name").alias("subscriber"), name(_ALERTS, (key % 5 + 1).cast("int")).alias("alert"),
        F.when(key % 4 != 0, (key + 200).cast("double")).alias("threshold"), (key % 3 != 2).alias("above"),
    )
    kinds = F.create_map(*[F.lit(x) for pair in _ALERT_OF.items() for x in pair])
    return D.threshold_alerts(t.metric.withColumn("alert", kinds[F.col("metric")]).drop("metric", "cents"), subscribers)


@query(
    "client_lockout",
    "T5",
    """WITH p AS (SELECT connection_id, ts_ms, id, cents AS c, CASE WHEN id % 29 <> 0 THEN (id//40)*3 - CASE WHEN (id//40) % 9 = 0 THEN 60 ELSE 0 END END AS rej, cents/12000*100 >= 85 AS hi FROM v_metric WHERE id % 31 <> 0),
      b AS (SELECT *, last_value(rej IGNORE NULLS) OVER (PARTITION BY connection_id ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms, id)),
      s AS (SELECT *, coalesce(greatest(0, rej - base), 0) > 0 AS ref, i - coalesce(max(CASE WHEN NOT hi THEN i END) OVER (PARTITION BY connection_id ORDER BY i), 0) AS st FROM b),
      v AS (SELECT *, CASE WHEN ref AND st >= 3 THEN 2 WHEN ref OR st >= 3 THEN 1 ELSE 0 END AS level FROM s),
      e AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id ORDER BY i) AS ep FROM v),
      m AS (SELECT *, max(level) OVER (PARTITION BY connection_id, ep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM e WHERE level > 0)
    SELECT connection_id, ts_ms, id, level FROM m WHERE level > coalesce(mx, 0)""",
)
def _lockout(t: Tables):
    step = F.floor(F.col("id") / 40)
    polls = t.metric.select(
        "connection_id", "ts_ms", "id", F.col("cents").alias("clients"), F.when(F.col("id") % 31 != 0, 12_000).alias("max_clients"),
        F.when(F.col("id") % 29 != 0, step * 3 - F.when(step % 9 == 0, 60).otherwise(0)).alias("rejected"),
    )
    return D.client_lockout(polls)


def loop_polls(t: Tables):
    """Event-loop readings that hold a band for a few polls."""
    band = F.floor(F.col("id") / 25) % 7
    busy = F.when(band == 2, 0.97).when(band.isin(3, 5), 0.85).when((F.col("id") % 17) == 0, 0.99).otherwise(0.3)
    return t.metric.select("connection_id", "ts_ms", "id", (busy * 1e6).alias("usec_per_cycle"), F.lit(1.0).alias("cycles_per_sec"))


@query("load_saturation", "T6", walks.LOAD)
def _load(t: Tables):
    return D.load_saturation(loop_polls(t))


def memory_polls(t: Tables):
    i, c = F.col("id"), F.col("cents")
    return t.metric.select(
        "connection_id", "ts_ms", "id", F.lit(100_000).alias("used"), F.when(F.floor(i / 50) % 8 == 3, 100_001).otherwise(c).alias("overhead"),
        F.lit(1_000).alias("startup"), (F.lit(100_000) - c).alias("dataset"), F.lit(50.0).alias("dataset_pct"), F.lit(50_000).alias("maxmemory"),
        F.when(i % 2 == 0, "allkeys-lru").otherwise("noeviction").alias("policy"), (i % 3).alias("evicted_delta"),
    )


@query(
    "memory_overhead",
    "T7",
    """WITH p AS (SELECT connection_id, ts_ms, id, cents AS c, (id//50) % 8 = 3 AS bad, row_number() OVER (PARTITION BY connection_id ORDER BY ts_ms, id) AS i FROM v_metric),
      k AS (SELECT *, i - coalesce(max(CASE WHEN NOT bad THEN i END) OVER (PARTITION BY connection_id ORDER BY i), 0) AS st FROM p),
      v AS (SELECT *, greatest(0, c-1000)/50000 AS share FROM p WHERE NOT bad),
      l AS (SELECT *, CASE WHEN share >= 0.5 OR (id % 2 = 0 AND id % 3 > 0 AND share >= 0.3 AND greatest(0, c-1000) > 100000 - c) THEN 2 WHEN share >= 0.3 THEN 1 ELSE 0 END AS level FROM v),
      w AS (SELECT *, lag(level) OVER (PARTITION BY connection_id ORDER BY i) AS b FROM l)
    SELECT connection_id, ts_ms, id, level, 'overhead' AS kind, share FROM w WHERE level > coalesce(b, 0)
    UNION ALL SELECT connection_id, ts_ms, id, 0, 'accounting', NULL FROM k WHERE bad AND st = 10""",
)
def _overhead(t: Tables):
    return D.memory_overhead(memory_polls(t))


@query(
    "fork_memory_risk",
    "T8",
    """WITH p AS (SELECT connection_id, ts_ms, id, (id//30) % 3 = 0 AS sv, (cents + CASE WHEN (id//30) % 3 = 0 THEN id % 5000 ELSE 4000 END)/40000 AS share, id % 2000 AS wr FROM v_metric),
      s AS (SELECT *, CASE WHEN sv AND share >= 0.9 THEN 21 WHEN sv AND share >= 0.8 THEN 11 WHEN NOT sv AND wr >= 1000 AND share >= 0.8 THEN 10 ELSE 0 END AS score FROM p),
      l AS (SELECT *, lag(score) OVER (PARTITION BY connection_id ORDER BY ts_ms, id) AS b FROM s)
    SELECT connection_id, ts_ms, id, CASE WHEN score = 21 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN score = 10 THEN 'projected' ELSE 'live' END AS kind, share FROM l WHERE score > coalesce(b, 0)""",
)
def _fork(t: Tables):
    i = F.col("id")
    polls = t.metric.select(
        "connection_id", "ts_ms", "id", (F.floor(i / 30) % 3 == 0).alias("saving"), F.col("cents").alias("used"), F.lit(None).cast("bigint").alias("rss"),
        (i % 5000).alias("cow"), F.lit(4000).alias("last_cow"), F.lit(40_000).alias("system"), (i % 2000).cast("double").alias("writes_per_sec"),
    )
    return D.fork_memory_risk(polls)


def buffers(t: Tables):
    return t.metric.select(
        "connection_id", F.concat(F.lit("10.2.0."), (F.col("id") % 3).cast("string")).alias("addr"), (F.col("ts_ms") / 60).cast("bigint").alias("ts_ms"), "id",
        F.col("cents").alias("omem"), F.lit(40_000).alias("hard_bytes"), F.lit(20_000).alias("soft_bytes"), F.lit(8).alias("soft_seconds"),
    )


@query(
    "replica_buffer_pressure",
    "T9",
    """WITH b AS (SELECT connection_id, concat('10.2.0.', id % 3) AS addr, ts_ms//60 AS ts_ms, id, cents/40000 AS h, cents FROM v_metric),
      k AS (SELECT *, h >= 0.6 AS oh, NOT h >= 0.6 AND cents >= 20000*CAST(0.6 AS DOUBLE) AS sf FROM b),
      e AS (SELECT *, sum(CASE WHEN NOT oh AND NOT sf THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id, addr ORDER BY ts_ms, id) AS ep FROM k),
      s AS (SELECT *, min(CASE WHEN sf THEN ts_ms END) OVER (PARTITION BY connection_id, addr, ep) AS since FROM e),
      l AS (SELECT *, sf AND ts_ms - since > 8000 AS sus FROM s), v AS (SELECT *, CASE WHEN h >= 0.9 THEN 2 WHEN h >= 0.6 THEN 1 WHEN sus THEN 1 ELSE 0 END AS level FROM l),
      w AS (SELECT *, lag(level) OVER o AS pl, lag(ts_ms) OVER o AS pt FROM v WINDOW o AS (PARTITION BY connection_id, addr ORDER BY ts_ms, id))
    SELECT connection_id, addr, ts_ms, id, level, CASE WHEN sus THEN 'soft_sustained' ELSE 'hard_approach' END AS kind FROM w WHERE level > CASE WHEN ts_ms - pt > 300000 THEN 0 ELSE coalesce(pl, 0) END""",
)
def _pressure(t: Tables):
    return D.replica_buffer_pressure(buffers(t))


@query("resync_after_pressure", "T9", walks.PRESSURE)
def _resync(t: Tables):
    rows = buffers(t).where(F.col("id") % 5 != 4)
    syncs = t.metric.where(F.col("id") % 5 == 4).select(
        "connection_id", (F.col("ts_ms") / 60).cast("bigint").alias("ts_ms"), F.lit(1).alias("sync_full_delta")
    )
    return D.resync_after_pressure(rows, syncs)


@query("unexplained_resyncs", "T9", walks.UNEXPLAINED)
def _unexplained(t: Tables):
    syncs = t.metric.select(
        "connection_id", (F.col("ts_ms") / 60).cast("bigint").alias("ts_ms"), "id",
        F.when(F.col("value") > 150, 1).otherwise(0).alias("sync_full_delta"), (F.col("id") % 7).alias("replicas"),
    )
    return D.unexplained_resyncs(syncs)


@query("control_plane_saturation", "T10", walks.CONTROL)
def _control(t: Tables):
    i = F.col("id")
    polls = t.metric.select(
        "connection_id", (F.col("ts_ms") / 60).cast("bigint").alias("ts_ms"), "id", F.when(F.floor(i / 40) % 4 == 1, 95.0).otherwise(20.0).alias("cpu_pct"),
        (F.col("value") * 10).alias("rtt_ms"), F.when(i % 97 == 0, 2).otherwise(0).alias("replica_drops"), (i % 1501 == 0).alias("restart"),
    )
    events = t.metric.where(F.col("value") > 450).select("connection_id", (F.col("ts_ms") / 60).cast("bigint").alias("ts_ms"))
    return D.control_plane_saturation(polls, events)


@query(
    "resync_loop",
    "T11",
    """WITH p AS (SELECT connection_id, ts_ms, id, (id//60) % 3 <> 0 AS dn, CASE WHEN id % 11 <> 0 THEN id % 60 + CASE WHEN id % 60 > 40 THEN -35 ELSE 0 END END AS d, metric IN ('click','view') AS sy FROM v_metric),
      o AS (SELECT *, sum(CASE WHEN NOT dn THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id ORDER BY ts_ms, id) AS ot FROM p), q AS (SELECT * FROM o WHERE dn),
      b AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY connection_id, ot ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base, lag(sy) OVER (PARTITION BY connection_id, ot ORDER BY ts_ms, id) AS was FROM q),
      w AS (SELECT *, sum(CASE WHEN coalesce(d < base, false) THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id, ot ORDER BY ts_ms, id) AS wd FROM b),
      c AS (SELECT *, sum(CASE WHEN NOT coalesce(d < base, false) AND coalesce(was, false) AND NOT sy THEN 1 ELSE 0 END) OVER x AS fc, min(ts_ms) OVER (PARTITION BY connection_id, ot, wd) AS st FROM w WINDOW x AS (PARTITION BY connection_id, ot, wd ORDER BY ts_ms, id))
    SELECT connection_id, ts_ms, id, failed_cycles FROM (SELECT connection_id, ts_ms, id, CAST(fc AS BIGINT) AS failed_cycles, row_number() OVER (PARTITION BY connection_id, ot, wd ORDER BY ts_ms, id) AS rn FROM c WHERE ts_ms - st >= 300000 AND fc >= 2) WHERE rn = 1""",
)
def _resync_loop(t: Tables):
    i = F.col("id")
    polls = t.metric.select(
        "connection_id", "ts_ms", "id", F.lit("replica").alias("role"), F.when(F.floor(i / 60) % 3 != 0, "down").otherwise("up").alias("link"),
        F.when(i % 11 != 0, i % 60 + F.when(i % 60 > 40, -35).otherwise(0)).alias("down_s"), F.col("metric").isin("click", "view").alias("syncing"),
    )
    return D.resync_loop(polls)


@query("failover_churn", "T12", walks.CHURN)
def _churn(t: Tables):
    i = F.col("id")
    claims = t.metric.select(
        "connection_id", F.floor(F.col("ts_ms") / 3_600_000).alias("h"), "id",
        F.concat(F.lit("s"), (i % 3).cast("string")).alias("shard"), F.concat(F.lit("n"), (F.floor(i / 37) % 5).cast("string")).alias("node_id"),
        F.floor(i / 37).alias("epoch"), (F.col("metric") != "error").alias("live"), (F.col("metric") == "error").alias("unhealthy"), (i % 41 == 0).alias("resharding"),
    )
    return D.failover_churn(claims.withColumn("ts_ms", F.col("h") * 8_000).drop("h", "id"))


@query("raft_health", "T13", walks.RAFT)
def _raft(t: Tables):
    i = F.col("id")
    stage = F.floor(i / 80) % 5
    polls = t.metric.select(
        "connection_id", (F.col("ts_ms") / 60).cast("bigint").alias("ts_ms"), "id",
        F.when(stage == 2, F.when(i % 3 == 0, "pre-candidate").otherwise("follower")).when(stage == 3, "leader").otherwise("follower").alias("role"),
        F.floor(i / 27).alias("term"), F.floor(i / 80).alias("commit"),
    )
    return D.raft_health(polls)


@query("persistence_stall", "T14", walks.STALL)
def _stall(t: Tables):
    i = F.col("id")
    run = F.floor(i / 50)
    polls = t.metric.select(
        "connection_id", F.when(i % 2 == 0, "rdb").otherwise("aof").alias("child"), (F.col("ts_ms") / 6).cast("bigint").alias("ts_ms"), "id",
        (run % 3 != 0).alias("in_progress"), ((i % 50) * 20).alias("elapsed_s"), F.least(i % 50, F.lit(20)).alias("processed"), F.lit(30).cast("bigint").alias("total"),
        F.when(run % 7 == 6, "err").otherwise("ok").alias("status"),
    )
    return D.persistence_stall(polls)


def sightings(t: Tables):
    """Nodes seen per hour: every client of the hour is a member of the view."""
    return t.client.groupBy("connection_id", F.col("captured_ms").alias("ts_ms"), F.concat("user_name", F.lit("/"), "name").alias("node_id")).agg(
        F.bool_or(F.col("idle") < 700).alias("live")
    )


@query("forget_rejoin", "T15", walks.REJOIN)
def _rejoin(t: Tables):
    return D.forget_rejoin(sightings(t))


def acl_scans(t: Tables):
    """Cumulative denial counters, scanned whenever they grow."""
    return t.counter.select(
        "connection_id", F.concat("metric", F.lit("/"), (F.col("id") % 3).cast("string")).alias("entry_id"), (F.col("ts_ms") / 60).cast("bigint").alias("ts_ms"),
        (F.col("total") / 40).cast("bigint").alias("count"), F.lit(0).cast("bigint").alias("created_ms"), F.lit("auth").alias("reason"),
        F.concat(F.lit("id=1 addr=10.3.0."), (F.col("id") % 3).cast("string"), F.lit(":5000 name=x")).alias("client_info"), "id",
    ).groupBy("connection_id", "entry_id", "ts_ms", "created_ms", "reason", "client_info").agg(F.max("count").alias("count"))


@query("auth_failure_bursts", "T16", walks.BURSTS)
def _bursts(t: Tables):
    return D.auth_failure_bursts(acl_scans(t))


def ticks(t: Tables):
    """Hourly 99th percentiles of each connection's vector searches."""
    hourly = latency.latency_trend(t.log, ORIGIN_MS, ORIGIN_MS + 30 * DAY, HOUR, ["connection_id"])
    return hourly.where(F.col("bucket").startswith(latency.SEARCH)).select("connection_id", "bucket", F.col("bin_ms").alias("ts_ms"), "p99")


@query(
    "sla_breaches",
    "T17",
    f"""WITH RECURSIVE k AS (SELECT connection_id, concat('FT.SEARCH:', key) AS bucket, {ORIGIN_MS} + (ts_ms-{ORIGIN_MS})//3600000*3600000 AS ts_ms, quantile_disc(value, 0.99) AS p99 FROM v_log WHERE log_type='slow' AND verb='FT.SEARCH' AND ts_ms >= {ORIGIN_MS} AND ts_ms < {ORIGIN_MS + 30 * DAY} GROUP BY 1,2,3),
      e AS (SELECT *, sum(CASE WHEN p99 <= 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id, bucket ORDER BY ts_ms) AS ep FROM k), b AS (SELECT * FROM e WHERE p99 > 60000),
      n AS (SELECT x.connection_id, x.bucket, x.ep, x.ts_ms AS t, min(y.ts_ms) AS nxt FROM b x LEFT JOIN b y ON y.connection_id = x.connection_id AND y.bucket = x.bucket AND y.ep = x.ep AND y.ts_ms >= x.ts_ms + 7200000 GROUP BY 1,2,3,4),
      f AS (SELECT connection_id, bucket, ep, min(ts_ms) AS t FROM b GROUP BY 1,2,3
        UNION ALL SELECT f.connection_id, f.bucket, f.ep, n.nxt FROM f JOIN n ON n.connection_id = f.connection_id AND n.bucket = f.bucket AND n.ep = f.ep AND n.t = f.t WHERE n.nxt IS NOT NULL)
    SELECT f.connection_id, f.bucket, f.t AS ts_ms, b.p99 FROM f JOIN b ON b.connection_id = f.connection_id AND b.bucket = f.bucket AND b.ts_ms = f.t""",
)
def _sla(t: Tables):
    return D.sla_breaches(ticks(t), 60_000, 2 * HOUR)


def command_samples(t: Tables):
    """Hourly p99 stand-ins per command, compressed to minutes, with a major version that rises."""
    hour = F.floor(F.col("ts_ms") / 3_600_000)
    per = t.metric.groupBy("connection_id", F.col("metric").alias("command"), hour.alias("h")).agg(
        F.max("cents").cast("double").alias("p99_us"), (F.count(F.lit(1)) * 60).cast("double").alias("calls_per_min")
    )
    first = F.floor(F.lit(ORIGIN_MS) / 3_600_000)
    return per.select(
        "connection_id", "command", ((F.col("h") - first) * 60_000).alias("ts_ms"), "p99_us", "calls_per_min",
        F.when(F.col("h") - first > 400, 9).otherwise(8).alias("major"),
    )


@query("upgrade_regressions", "T18", walks.UPGRADE)
def _upgrade(t: Tables):
    return D.upgrade_regressions(command_samples(t), factor=1.05, needed=2)


@query("sustained_regressions", "T18", walks.SUSTAINED)
def _sustained(t: Tables):
    return D.sustained_regressions(command_samples(t), factor=1.2, needed=2)


@query(
    "persistence_gate",
    "T19",
    """WITH p AS (SELECT connection_id, ts, row_number() OVER (PARTITION BY connection_id ORDER BY ts) AS i FROM (SELECT DISTINCT connection_id, ts_ms//3600000 AS ts FROM v_metric)),
      f AS (SELECT DISTINCT connection_id, metric AS signature, ts_ms//3600000 AS ts FROM v_metric WHERE value > 20),
      j AS (SELECT f.*, i, i - row_number() OVER (PARTITION BY connection_id, signature ORDER BY i) AS grp FROM f JOIN p USING (connection_id, ts)),
      s AS (SELECT *, min(ts) OVER (PARTITION BY connection_id, signature, grp) AS since FROM j)
    SELECT connection_id, signature, since AS since_ms, min(ts) AS alert_ms FROM s WHERE ts - since >= 2 GROUP BY connection_id, signature, grp, since""",
)
def _gate(t: Tables):
    hourly = t.metric.withColumn("ts_ms", F.floor(F.col("ts_ms") / 3_600_000))
    found = hourly.where(F.col("value") > 20).select("connection_id", F.col("metric").alias("signature"), "ts_ms").distinct()
    return D.persistence_gate(found, hourly.select("connection_id", "ts_ms"), 2)


@query(
    "session_intervals",
    "T21",
    """WITH g AS (SELECT *, ts_ms - lag(ts_ms) OVER w >= 7200000 AS brk FROM (SELECT concat('t', user_id) AS thread_id, ts_ms, event_id AS id FROM v_ev) WINDOW w AS (PARTITION BY thread_id ORDER BY ts_ms, id)),
      s AS (SELECT *, sum(CASE WHEN coalesce(brk, true) THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY ts_ms, id) AS n FROM g)
    SELECT thread_id, min(ts_ms) AS start_ms, max(ts_ms) + 7200000 AS expires_ms, count(*) AS touches FROM s GROUP BY thread_id, n""",
)
def _sessions(t: Tables):
    reads = t.events.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id"), "ts_ms", F.col("event_id").alias("id"))
    return D.session_intervals(reads, 2 * HOUR)


@query("admitted_requests", "T22", walks.ADMITTED)
def _admitted(t: Tables):
    requests = t.metric.select(F.col("connection_id").alias("rate_key"), "ts_ms", "id")
    return D.admitted_requests(requests, 5, 2 * HOUR)


@query("miss_cost_backfill", "J24", walks.BACKFILL)
def _backfill(t: Tables):
    events = t.metric.select(
        F.concat("connection_id", F.lit("/"), (F.col("id") % 10).cast("string")).alias("prompt"), (F.col("ts_ms") / 60).cast("bigint").alias("ts_ms"), "id",
        F.when(F.col("metric").isin("click", "view", "error"), "miss").otherwise("store").alias("kind"), F.col("cents").alias("cost"),
    )
    return D.miss_cost_backfill(events)


def proposals(t: Tables):
    return t.metric.select(
        F.col("id").alias("proposal_id"), F.when(F.col("metric") == "click", "applied").otherwise("pending").alias("status"), (F.col("ts_ms") + DAY).alias("expires_ms")
    )


@query(
    "expired_proposals",
    "T24",
    f"SELECT id AS proposal_id, CASE WHEN metric = 'click' THEN 'applied' WHEN ts_ms + {DAY} <= {ORIGIN_MS + 20 * DAY} THEN 'expired' ELSE 'pending' END AS status FROM v_metric",
)
def _expired(t: Tables):
    return D.expire_proposals(proposals(t), ORIGIN_MS + 20 * DAY).select("proposal_id", "status")


@query(
    "proposal_status",
    "T24",
    "SELECT id % 500 AS proposal_id, arg_max(metric, (ts_ms, id)) AS status, count(*) AS changes FROM v_metric GROUP BY 1",
)
def _status(t: Tables):
    return D.latest_proposal_status(t.metric.select((F.col("id") % 500).alias("proposal_id"), "ts_ms", "id", F.col("metric").alias("status")))


SIGNALS = ("uncertain_hits", "distant_hits", "near_misses", "low_hit_rate")


@query(
    "outcome_evaluation",
    "T25",
    f"""WITH a AS (SELECT s_suppkey AS pid, concat('cat', s_suppkey % 3) AS category, {ORIGIN_MS} + s_suppkey*3600000 AS ap, {ORIGIN_MS} + s_suppkey*3600000 + {3 * DAY} AS un, CAST(0.25 AS DOUBLE) + s_nationkey/CAST(1000 AS DOUBLE) AS t,
        ['uncertain_hits','distant_hits','near_misses','low_hit_rate'][s_suppkey % 4 + 1] AS signal, (s_nationkey % 5)/CAST(10 AS DOUBLE) AS br FROM supplier),
      g AS (SELECT pid, signal, br, count(*) AS n, count(*) FILTER (result='hit') AS h, count(*) FILTER (result='hit' AND score >= t - CAST(0.05 AS DOUBLE)) AS u, count(*) FILTER (result='hit' AND score > t/2) AS d,
        count(*) FILTER (result='miss' AND score > t AND score <= t + CAST(0.05 AS DOUBLE)) AS m FROM a JOIN v_sim s ON s.category = a.category AND s.ts_ms BETWEEN ap AND un GROUP BY 1,2,3),
      r AS (SELECT *, CASE signal WHEN 'uncertain_hits' THEN CASE WHEN h > 0 THEN u/h ELSE 0 END WHEN 'distant_hits' THEN CASE WHEN h > 0 THEN d/h ELSE 0 END WHEN 'near_misses' THEN CASE WHEN n > h THEN m/(n-h) ELSE 0 END ELSE h/n END AS ar FROM g),
      v AS (SELECT *, CASE WHEN signal = 'low_hit_rate' THEN 1 ELSE -1 END * CASE WHEN br = 0 THEN CASE WHEN ar = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE (ar-br)/br END AS better FROM r)
    SELECT pid AS proposal_id, signal, n AS samples, br AS before_rate, ar AS after_rate, CASE WHEN better > 0.1 THEN 'improved' WHEN better < -0.1 THEN 'degraded' ELSE 'neutral' END AS verdict FROM v""",
)
def _outcomes(t: Tables):
    key = F.col("s_suppkey")
    applied = F.lit(ORIGIN_MS) + key * HOUR
    adjustments = t.table("supplier").select(
        key.alias("proposal_id"), F.concat(F.lit("cat"), (key % 3).cast("string")).alias("category"), applied.alias("applied_ms"), (applied + 3 * DAY).alias("until_ms"),
        (F.lit(0.25) + F.col("s_nationkey") / F.lit(1000.0)).alias("threshold"),
        F.element_at(F.array(*[F.lit(s) for s in SIGNALS]), (key % 4 + 1).cast("int")).alias("signal"), ((F.col("s_nationkey") % 5) / F.lit(10.0)).alias("before_rate"),
    )
    return D.outcome_evaluation(adjustments, t.sim)


@query("reconciled_facts", "V15", walks.FACTS)
def _facts(t: Tables):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 90).cast("int")), "yyyy-MM-dd")
    rows = t.events.select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("scope"), F.concat(F.lit("Topic "), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(" is "), (F.col("event_id") % 3).cast("string")).alias("statement"),
        F.when(F.col("event_id") % 5 != 0, day).alias("date"), (F.col("event_type") == "error").alias("tombstone"), "ts_ms",
    )
    old = F.col("ts_ms") < ORIGIN_MS + 10 * DAY
    return D.reconcile_facts(rows.where(old), rows.where(~old))
