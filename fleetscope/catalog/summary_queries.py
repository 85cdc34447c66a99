"""Audit, anomaly, cache, delivery and fleet summaries."""

from pyspark.sql import functions as F

from fleetscope.catalog.registry import query
from fleetscope.catalog.views import ORIGIN_MS, Tables
from fleetscope.operators import summaries as S
from fleetscope.operators import topology


def acl(t: Tables):
    return t.client.select(F.col("cmd").alias("reason"), F.col("user_name").alias("username"), "captured_ms")


def anomaly_events(t: Tables):
    value = F.col("value")
    return t.metric.select(
        "connection_id",
        "id",
        "ts_ms",
        "metric",
        "value",
        F.when(value > 100, "critical").when(value > 50, "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("pattern"),
        (F.col("id") % 2 == 0).alias("resolved"),
    )


def _dims(frm, dims, aggs):
    total = f"SELECT 'total' AS dim, '' AS label, {aggs} FROM {frm}"
    return " UNION ALL ".join(
        [total] + [f"SELECT '{n}' AS dim, {e} AS label, {aggs} FROM {frm} GROUP BY {e}" for n, e in dims]
    )


@query(
    "audit_stats",
    "A8",
    _dims(
        "v_client",
        [("reason", "cmd"), ("username", "user_name")],
        "count(*) AS entries, count(DISTINCT user_name) AS users, min(captured_ms) AS earliest_ms, max(captured_ms) AS latest_ms",
    ),
)
def _audit(t: Tables):
    return S.audit_stats(acl(t))


@query(
    "anomaly_stats",
    "A9",
    "WITH a AS (SELECT *, CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'warning' ELSE 'info' END AS severity,"
    " concat('p', id % 3) AS pattern, id % 2 = 0 AS resolved FROM v_metric) "
    + _dims(
        "a",
        [("severity", "severity"), ("metric", "metric"), ("pattern", "pattern")],
        "count(*) AS events, count(*) FILTER (NOT resolved) AS active, count(*) FILTER (resolved) AS resolved_n",
    ),
)
def _anomaly_stats(t: Tables):
    return S.anomaly_stats(anomaly_events(t))


def operations(t: Tables):
    return t.sim.select(
        F.when(F.col("id") % 3 == 0, "llm").otherwise("tool").alias("tier"),
        F.when(F.col("id") % 3 != 0, F.col("category")).otherwise("").alias("tool"),
        (F.col("result") == "hit").alias("hit"),
        "cost_micros",
    )


_OPS = """o AS (SELECT CASE WHEN id % 3 = 0 THEN 'llm' ELSE 'tool' END AS tier, CASE WHEN id % 3 <> 0 THEN category ELSE '' END AS tool,
  result = 'hit' AS hit, cost_micros FROM v_sim)"""
_CACHE = "SELECT *, CASE WHEN hits+misses > 0 THEN hits/(hits+misses) ELSE 0 END AS hit_rate FROM (" + _dims(
    "o",
    [("tier", "tier"), ("tool", "tool")],
    "count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(coalesce(sum(cost_micros) FILTER (hit), 0) AS BIGINT) AS cost_saved_micros",
) + ")"


@query("cache_stats", "A25", f"WITH {_OPS} {_CACHE}")
def _cache_stats(t: Tables):
    return S.cache_stats(operations(t))


@query(
    "agent_cache_health",
    "A26",
    f"WITH {_OPS} SELECT dim, label, hits+misses AS ops, hit_rate, hits+misses < 100 AS warn_few_ops, "
    f"hits+misses >= 100 AND hit_rate < 0.3 AS warn_low_hit_rate FROM ({_CACHE})",
)
def _agent_health(t: Tables):
    return S.agent_cache_health(S.cache_stats(operations(t)))


@query(
    "semantic_cache_health",
    "A26",
    """SELECT dim, label, ops, hit_rate, miss_rate, uncertain_hit_rate, ops < 100 AS warn_few_ops, ops >= 100 AND hit_rate < 0.2 AS warn_low_hit_rate,
    uncertain_hit_rate > 0.25 AS warn_uncertain FROM (SELECT *, h/ops AS hit_rate, (ops-h)/ops AS miss_rate, CASE WHEN h > 0 THEN u/h ELSE 0 END AS uncertain_hit_rate FROM ("""
    + _dims(
        "v_sim",
        [("category", "category")],
        "count(*) AS ops, count(*) FILTER (result = 'hit') AS h, count(*) FILTER (result = 'hit' AND score >= CAST(0.3 AS DOUBLE)-CAST(0.05 AS DOUBLE)) AS u",
    )
    + "))",
)
def _semantic_health(t: Tables):
    return S.cache_health(t.sim, 0.3, 0.05)


@query(
    "similarity_distribution",
    "A27",
    """WITH g AS (SELECT CAST(greatest(0, least(19, floor(score/CAST(0.1 AS DOUBLE)))) AS BIGINT) AS bucket, count(*) FILTER (result = 'hit') AS h,
      count(*) FILTER (result <> 'hit') AS m FROM v_sim GROUP BY 1)
    SELECT r.range AS bucket, r.range*CAST(0.1 AS DOUBLE) AS lower, coalesce(h, 0) AS hit_count, coalesce(m, 0) AS miss_count
    FROM range(20) r LEFT JOIN g ON g.bucket = r.range""",
)
def _distribution(t: Tables):
    return S.similarity_distribution(t.sim)


@query(
    "similarity_window_summary",
    "A28",
    """SELECT category, count(*) AS n, count(*) FILTER (result <> 'miss') AS hits,
    CAST(CAST(sum(CAST(round(score*1e9) AS BIGINT)) AS BIGINT) AS DOUBLE)/count(*)/CAST(1e9 AS DOUBLE) AS avg_score FROM v_sim GROUP BY 1""",
)
def _window(t: Tables):
    return S.window_summary(t.sim)


@query(
    "instance_samples",
    "A29",
    """WITH p AS (SELECT connection_id AS instance, CAST(coalesce(sum(floor(value)) FILTER (metric='click'),0) AS BIGINT) AS hits,
      CAST(coalesce(sum(floor(value)) FILTER (metric='view'),0) AS BIGINT) AS misses, CAST(coalesce(sum(floor(value)) FILTER (metric='purchase'),0) AS BIGINT) AS cost_saved_micros,
      CAST(coalesce(sum(floor(value)) FILTER (metric='signup'),0) AS BIGINT) AS evictions, CAST(sum(floor(value)) FILTER (metric='error') AS BIGINT) AS items FROM v_metric GROUP BY 1)
    SELECT *, CASE WHEN hits+misses > 0 THEN hits/(hits+misses) END AS hit_rate FROM p""",
)
def _instances(t: Tables):
    field = F.create_map(
        *[
            F.lit(x)
            for pair in zip(
                ("click", "view", "purchase", "signup", "error"),
                ("hits", "misses", "cost_saved_micros", "evictions", "items"),
            )
            for x in pair
        ]
    )[F.col("metric")]
    counters = t.metric.select(
        F.col("connection_id").alias("instance"), field.alias("field"), F.floor("value").alias("amount")
    )
    return S.instance_sample(counters)


@query(
    "event_timeline",
    "A43",
    """WITH e AS (SELECT CASE WHEN metric = 'error' THEN 'critical' WHEN metric = 'signup' THEN 'warning' WHEN metric = 'view' THEN 'latency' ELSE 'slow' END AS kind, ts_ms,
        CAST(floor(value) AS BIGINT) AS value FROM v_metric),
      g AS (SELECT CAST(greatest(0, least(59, floor((ts_ms-1704153600000)/CAST(41760000 AS DOUBLE)))) AS BIGINT) AS bucket, count(*) FILTER (kind='slow') AS slow,
        max(value) FILTER (kind='slow') AS slow_max, count(*) FILTER (kind='critical') AS critical, count(*) FILTER (kind='warning') AS warning,
        max(value) FILTER (kind='latency') AS latency_max FROM e GROUP BY 1)
    SELECT r.range AS bucket, 1704153600000 + r.range*CAST(41760000 AS DOUBLE) AS start_ms, coalesce(slow,0) AS slow, coalesce(slow_max,0) AS slow_max,
      coalesce(critical,0) AS critical, coalesce(warning,0) AS warning, coalesce(latency_max,0) AS latency_max FROM range(60) r LEFT JOIN g ON g.bucket = r.range""",
)
def _event_timeline(t: Tables):
    kind = (
        F.when(F.col("metric") == "error", "critical")
        .when(F.col("metric") == "signup", "warning")
        .when(F.col("metric") == "view", "latency")
        .otherwise("slow")
    )
    events = t.metric.select(kind.alias("kind"), "ts_ms", F.floor("value").alias("value"))
    day = 86_400_000
    return S.event_timeline(events, ORIGIN_MS + day, ORIGIN_MS + 30 * day, 60)


@query(
    "overhead_report",
    "A37",
    """WITH g AS (SELECT metric AS workload, id % 2 = 1 AS monitored, CAST(count(*) AS DOUBLE) AS n, CAST(sum(cents) AS DOUBLE) AS s,
        CAST(count(*)*CAST(sum(cents*cents) AS HUGEINT) - CAST(sum(cents) AS HUGEINT)*CAST(sum(cents) AS HUGEINT) AS DOUBLE) AS d FROM v_metric GROUP BY 1,2),
      m AS (SELECT workload, monitored, s/n AS mean, sqrt(d)/n/(s/n)*100 AS cv FROM g)
    SELECT b.workload, b.mean AS base_mean, b.cv AS base_cv_pct, w.mean AS watched_mean, w.cv AS watched_cv_pct,
      (b.mean - w.mean)/b.mean*100 AS overhead_pct FROM m b JOIN m w ON b.workload = w.workload AND NOT b.monitored AND w.monitored""",
)
def _overhead(t: Tables):
    runs = t.metric.select(
        F.col("metric").alias("workload"), (F.col("id") % 2 == 1).alias("monitored"), F.col("cents").alias("units")
    )
    return S.overhead_report(runs)


def deliveries(t: Tables):
    return t.events.select(
        F.concat(F.lit("w"), (F.col("user_id") % 12).cast("string")).alias("subscriber"),
        F.col("event_id").alias("id"),
        F.col("ts_ms").alias("created_ms"),
        F.when(F.col("event_type").isin("error", "view"), "failed")
        .when(F.col("event_type") == "signup", "pending")
        .otherwise("success")
        .alias("status"),
        (F.col("event_id") % 7).alias("attempts"),
    )


DELIVERIES = """d AS (SELECT concat('w', user_id % 12) AS subscriber, event_id AS id, ts_ms AS created_ms,
  CASE WHEN event_type IN ('error','view') THEN 'failed' WHEN event_type = 'signup' THEN 'pending' ELSE 'success' END AS status, event_id % 7 AS attempts FROM v_ev)"""
_HEALTH = f"""{DELIVERIES}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY created_ms DESC, id DESC) AS rn FROM d) WHERE rn <= 100),
  f AS (SELECT subscriber, min(rn) FILTER (status='success') AS ok FROM r GROUP BY 1),
  h AS (SELECT r.subscriber, count(*) AS deliveries, count(*) FILTER (status='success') AS succeeded, count(*) FILTER (status='failed') AS failed,
    max(created_ms) AS last_ms, count(*) FILTER (status='failed' AND (ok IS NULL OR rn < ok)) AS consecutive_failures FROM r JOIN f USING (subscriber) GROUP BY 1),
  health AS (SELECT *, succeeded/deliveries AS success_rate, succeeded/deliveries >= 0.5 AND consecutive_failures < 5 AS healthy FROM h)"""


@query("delivery_health", "A33", f"WITH {_HEALTH} SELECT * FROM health")
def _delivery_health(t: Tables):
    return S.delivery_health(deliveries(t))


@query(
    "delivery_fleet_summary",
    "A33",
    f"""WITH {_HEALTH} SELECT count(*) AS subscribers, count(*) FILTER (healthy) AS healthy, count(*) FILTER (NOT healthy) AS unhealthy,
    CAST(sum(succeeded) AS DOUBLE)/CAST(sum(deliveries) AS DOUBLE) AS overall_success_rate FROM health""",
)
def _delivery_fleet(t: Tables):
    return S.delivery_fleet_summary(S.delivery_health(deliveries(t)))


@query(
    "node_imbalance",
    "A35",
    """WITH n AS (SELECT node_id, config_epoch AS grp, gauge AS memory, gauge % 1000 AS ops, gauge % 77 AS clients FROM v_node),
      m AS (SELECT *, avg(memory) OVER w AS mm, avg(ops) OVER w AS mo, avg(clients) OVER w AS mc FROM n WINDOW w AS (PARTITION BY grp))
    SELECT grp, node_id, abs(memory-mm)/CASE WHEN mm = 0 THEN 1 ELSE mm END > 0.2 AS memory_off, abs(ops-mo)/CASE WHEN mo = 0 THEN 1 ELSE mo END > 0.2 AS ops_off,
      abs(clients-mc)/CASE WHEN mc = 0 THEN 1 ELSE mc END > 0.2 AS clients_off FROM m
    WHERE abs(memory-mm)/CASE WHEN mm = 0 THEN 1 ELSE mm END > 0.2 OR abs(ops-mo)/CASE WHEN mo = 0 THEN 1 ELSE mo END > 0.2 OR abs(clients-mc)/CASE WHEN mc = 0 THEN 1 ELSE mc END > 0.2""",
)
def _imbalance(t: Tables):
    nodes = t.node.select(
        F.col("config_epoch").alias("grp"),
        "node_id",
        F.col("gauge").alias("memory"),
        (F.col("gauge") % 1000).alias("ops"),
        (F.col("gauge") % 77).alias("clients"),
    )
    return topology.node_imbalance(nodes)


@query(
    "vector_fleet_totals",
    "A41",
    """WITH i AS (SELECT connection_id, metric, arg_max(struct_pack(d := cents, p := id % 101), (ts_ms, id)) AS s FROM v_metric GROUP BY 1,2)
    SELECT connection_id, count(*) AS indexes, CAST(sum(s.d) AS BIGINT) AS docs, CAST(sum(s.d*64) AS BIGINT) AS memory_bytes,
    count(*) FILTER (s.p < 100) AS building, count(*) FILTER (s.p % 5 = 0) AS failing FROM i GROUP BY 1""",
)
def _fleet_totals(t: Tables):
    latest = t.metric.groupBy("connection_id", "metric").agg(
        F.max_by(F.struct("cents", "id"), F.struct("ts_ms", "id")).alias("s")
    )
    indexes = latest.select(
        "connection_id",
        F.col("metric").alias("index_name"),
        F.col("s.cents").alias("num_docs"),
        (F.col("s.cents") * 64).alias("memory_bytes"),
        (F.col("s.id") % 101).alias("percent_indexed"),
        F.when(F.col("s.id") % 101 % 5 == 0, 1).otherwise(0).alias("failures"),
    )
    return topology.vector_fleet_totals(indexes)


@query(
    "baseline_comparison",
    "A38",
    """WITH b AS (SELECT connection_id, metric, count(*) AS n, CAST(sum(cents) AS DOUBLE)/count(*) AS base FROM v_metric WHERE ts_ms < 1705276800000 GROUP BY 1,2),
      c AS (SELECT connection_id, metric, CAST(arg_max(cents, (ts_ms, id)) AS DOUBLE) AS cur FROM v_metric GROUP BY 1,2)
    SELECT connection_id, metric, n AS snapshots, CASE WHEN n >= 5 THEN floor(base*100+0.5)/100 END AS baseline, floor(cur*100+0.5)/100 AS current_value,
      CASE WHEN n >= 5 AND base <> 0 THEN floor((cur-base)/base*100*100+0.5)/100 END AS delta_pct,
      CASE WHEN n < 5 OR base = 0 THEN 'unavailable' WHEN (cur-base)/base*100 > 50 THEN 'elevated' WHEN (cur-base)/base*100 < -30 THEN 'degraded' ELSE 'normal' END AS status
    FROM b JOIN c USING (connection_id, metric)""",
)
def _baseline(t: Tables):
    metric = t.metric.withColumnRenamed("cents", "reading")
    limits = {m: (50.0, -30.0) for m in ("click", "view", "purchase", "signup", "error")}
    return topology.baseline_comparison(metric, ORIGIN_MS + 14 * 86_400_000, limits)
