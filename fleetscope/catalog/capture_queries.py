"""Capture comparison, trigger, subscription and validation queries."""

from pyspark.sql import functions as F

from fleetscope.catalog.registry import query
from fleetscope.catalog.summary_queries import DELIVERIES, deliveries
from fleetscope.catalog.views import ORIGIN_MS, Tables
from fleetscope.operators import captures as C

DAY, HOUR = 86_400_000, 3_600_000
SESSION = (ORIGIN_MS + 20 * DAY, ORIGIN_MS + 22 * DAY)
BASE = C.baseline_window("7d", SESSION[0])


def captured(t: Tables):
    """Log entries as captured lines; service 3 adds an argument to its commands."""
    extra = F.when(F.col("client_name") == "svc3", F.concat("args", F.array(F.lit("NX")))).otherwise(F.col("args"))
    return t.log.withColumn("args", extra)


_SHAPE = "concat(upper(args[1]), ':', len(args) - 1)"
CAPTURED = "l AS (SELECT * REPLACE (CASE WHEN client_name = 'svc3' THEN list_append(args, 'NX') ELSE args END AS args) FROM v_log)"
_IN = "ts_ms >= {} AND ts_ms <= {}"


@query(
    "new_command_shapes",
    "J1 J4 P5",
    f"""WITH {CAPTURED}, s AS (SELECT connection_id, {_SHAPE} AS shape, upper(args[1]) AS verb, count(*) AS n FROM l WHERE {_IN.format(*SESSION)} GROUP BY 1,2,3),
      b AS (SELECT DISTINCT connection_id, concat(upper(verb), ':', len(args)-1) AS shape FROM v_log WHERE {_IN.format(*BASE)}),
      c AS (SELECT DISTINCT connection_id, upper(CASE WHEN cmd = 'click' THEN 'GET' ELSE cmd END) AS verb FROM v_client WHERE captured_ms >= {BASE[0]} AND captured_ms <= {BASE[1]})
    SELECT connection_id, verb, shape, n FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.connection_id = s.connection_id AND b.shape = s.shape)
      AND NOT EXISTS (SELECT 1 FROM c WHERE c.connection_id = s.connection_id AND c.verb = s.verb)""",
)
def _new_shapes(t: Tables):
    clients = C.between(t.client.withColumnRenamed("captured_ms", "ts_ms"), *BASE).select(
        "connection_id", F.when(F.col("cmd") == "click", "GET").otherwise(F.col("cmd")).alias("cmd")
    )
    return C.new_shapes(C.between(captured(t), *SESSION), C.between(t.log, *BASE), clients)


def _delta_sql(a, b):
    return f"""na AS (SELECT connection_id, key, count(*) AS n_capture FROM v_log WHERE {a} GROUP BY 1,2), nb AS (SELECT connection_id, key, count(*) AS n_baseline FROM v_log WHERE {b} GROUP BY 1,2),
      ra AS (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY n_capture DESC, key) AS rank_capture FROM na),
      rb AS (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY n_baseline DESC, key) AS rank_baseline FROM nb),
      hd AS (SELECT ra.connection_id, ra.key, n_capture, rank_capture, coalesce(nb.n_baseline, 0) AS n_baseline, rb.rank_baseline,
        CASE WHEN rb.rank_baseline IS NULL THEN 'new' WHEN rb.rank_baseline <> rank_capture THEN 'moved' END AS change FROM ra
        LEFT JOIN nb ON nb.connection_id = ra.connection_id AND nb.key = ra.key
        LEFT JOIN rb ON rb.connection_id = ra.connection_id AND rb.key = ra.key AND rb.rank_baseline <= 50 WHERE rank_capture <= 50)"""


@query("hot_key_delta", "J2", f"WITH {_delta_sql(_IN.format(*SESSION), _IN.format(*BASE))} SELECT * FROM hd WHERE change IS NOT NULL")
def _hot_delta(t: Tables):
    return C.hot_key_delta(C.between(t.log, *SESSION), C.between(t.log, *BASE))


@query(
    "slowlog_regressions",
    "J3",
    f"""WITH v AS (SELECT DISTINCT connection_id, upper(verb) AS verb FROM v_log WHERE {_IN.format(*SESSION)}),
      b AS (SELECT connection_id, upper(verb) AS verb, count(*) AS n FROM v_log WHERE log_type='slow' AND {_IN.format(*BASE)} GROUP BY 1,2),
      s AS (SELECT connection_id, upper(verb) AS verb, count(*) AS n FROM v_log WHERE log_type='slow' AND {_IN.format(*SESSION)} GROUP BY 1,2),
      p AS (SELECT connection_id, quantile_cont(n/CAST(604800 AS DOUBLE), 0.95) AS p95 FROM b GROUP BY 1)
    SELECT v.connection_id, v.verb, s.n AS n_session, s.n/CAST(172800 AS DOUBLE) AS observed_rate, coalesce(b.n, 0)/CAST(604800 AS DOUBLE) AS baseline_rate, round(coalesce(p95, 0), 15) AS p95_rate
    FROM v JOIN s USING (connection_id, verb) LEFT JOIN b USING (connection_id, verb) LEFT JOIN p USING (connection_id) WHERE s.n/CAST(172800 AS DOUBLE) > coalesce(p95, 0)""",
)
def _regressions(t: Tables):
    slow = t.log.where(F.col("log_type") == "slow")
    found = C.slowlog_regressions(
        C.between(t.log, *SESSION), C.between(slow, *BASE), C.between(slow, *SESSION), BASE, SESSION
    )
    return found.withColumn("p95_rate", F.round("p95_rate", 15))


@query(
    "capture_diff",
    "J5",
    f"""WITH {CAPTURED}, {_delta_sql("ts_ms//86400000 = 19740", "ts_ms//86400000 = 19735")},
      sa AS (SELECT DISTINCT connection_id, {_SHAPE} AS shape FROM l WHERE ts_ms//86400000 = 19735), sb AS (SELECT DISTINCT connection_id, {_SHAPE} AS shape FROM l WHERE ts_ms//86400000 = 19740)
    SELECT connection_id, 'shape' AS kind, shape AS item, 'new' AS change FROM sb WHERE NOT EXISTS (SELECT 1 FROM sa WHERE sa.connection_id = sb.connection_id AND sa.shape = sb.shape)
    UNION ALL SELECT connection_id, 'key', key, change FROM hd WHERE change IS NOT NULL""",
)
def _diff(t: Tables):
    sessions = captured(t).withColumn("capture_id", F.floor(F.col("ts_ms") / DAY).cast("string"))
    return C.capture_diff(sessions, "19735", "19740")


def triggers_and_anomalies(t: Tables):
    """Every signup arms a trigger for six hours; every other event is an anomaly."""
    base = t.events.select(
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("connection_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("metric"),
        F.when(F.col("event_id") % 2 == 0, "spike").otherwise("drop").alias("anomaly_type"),
        "ts_ms",
        F.col("event_id").alias("id"),
        "event_type",
        (F.col("value") > 120).alias("blocked"),
        (F.col("value") > 60).alias("busy"),
    )
    keys = ["connection_id", "metric", "anomaly_type"]
    armed = base.where(F.col("event_type") == "signup").select(
        *keys, F.col("id").alias("trigger_id"), F.col("ts_ms").alias("created_ms"), (F.col("ts_ms") + 6 * HOUR).alias("expires_ms")
    )
    return armed, base.where(F.col("event_type") != "signup").drop("event_type")


@query(
    "match_triggers",
    "J9",
    """WITH b AS (SELECT concat('c', user_id % 4) AS connection_id, concat('m', user_id % 3) AS metric, CASE WHEN event_id % 2 = 0 THEN 'spike' ELSE 'drop' END AS anomaly_type, ts_ms, event_id AS id, event_type,
        value > 120 AS blocked, value > 60 AS busy FROM v_ev),
      t AS (SELECT * FROM b WHERE event_type = 'signup'), a AS (SELECT * FROM b WHERE event_type <> 'signup'),
      m AS (SELECT t.id AS tid, arg_min(struct_pack(id := a.id, ts := a.ts_ms, bl := a.blocked, bu := a.busy), (a.ts_ms, a.id)) AS h FROM t JOIN a ON t.connection_id = a.connection_id AND t.metric = a.metric
        AND t.anomaly_type = a.anomaly_type AND a.ts_ms >= t.ts_ms AND a.ts_ms < t.ts_ms + 21600000 GROUP BY 1)
    SELECT t.id AS trigger_id, connection_id, metric, anomaly_type, h.id AS anomaly_id, h.ts AS fired_ms, CASE WHEN h IS NULL THEN 'expired' WHEN h.bl THEN 'skipped' WHEN h.bu THEN 'queued' ELSE 'fired' END AS status
    FROM t LEFT JOIN m ON m.tid = t.id""",
)
def _triggers(t: Tables):
    return C.match_triggers(*triggers_and_anomalies(t))


@query(
    "event_subscriptions",
    "J25",
    """WITH s AS (SELECT s_name AS subscriber, CASE WHEN s_suppkey % 5 <> 0 THEN concat('c', s_suppkey % 4) END AS scope, unnest(CASE WHEN s_nationkey % 2 = 0 THEN ['click','error'] ELSE ['view'] END) AS event_type FROM supplier),
      e AS (SELECT connection_id, metric AS event_type, count(*) AS n, max(ts_ms) AS m FROM v_metric GROUP BY 1,2)
    SELECT subscriber, CAST(sum(n) AS BIGINT) AS events, max(m) AS last_ms FROM e JOIN s ON e.event_type = s.event_type AND (s.scope IS NULL OR s.scope = e.connection_id) GROUP BY 1""",
)
def _subscriptions(t: Tables):
    subscribers = t.table("supplier").select(
        F.col("s_name").alias("subscriber"),
        F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("c"), (F.col("s_suppkey") % 4).cast("string"))).alias("connection_id"),
        F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("click"), F.lit("error"))).otherwise(F.array(F.lit("view"))).alias("event_types"),
    )
    # Events of one kind and connection reach the same subscribers: count them before fanning out.
    events = t.metric.groupBy("connection_id", F.col("metric").alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("m")
    )
    return C.subscriptions(events, subscribers).groupBy("subscriber").agg(
        F.sum("n").alias("events"), F.max("m").alias("last_ms")
    )


@query(
    "dead_letters",
    "J26",
    f"""WITH {DELIVERIES}, p AS (SELECT concat('w', c_nationkey) AS subscriber, min(c_custkey % 5 + 1) AS max_retries FROM customer GROUP BY 1)
    SELECT d.subscriber, id, created_ms, status, attempts FROM d LEFT JOIN p USING (subscriber) WHERE status = 'failed' AND attempts >= coalesce(max_retries, 3)""",
)
def _dead(t: Tables):
    policies = (
        t.table("customer")
        .groupBy(F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias("subscriber"))
        .agg(F.min(F.col("c_custkey") % 5 + 1).alias("max_retries"))
    )
    return C.dead_letters(deliveries(t), policies)


def migration_sides(t: Tables):
    price = F.round(F.col("o_totalprice") * 100).cast("bigint")
    orders = t.table("orders").select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"),
        F.substring("o_orderpriority", 1, 1).alias("key_type"),
        price.alias("cents"),
        "o_orderstatus",
        "o_custkey",
    )
    source = orders.select("key", "key_type", F.md5(F.col("cents").cast("string")).alias("value_hash"))
    target = orders.where(F.col("o_orderstatus") != "P").select(
        "key",
        F.when(F.col("o_custkey") % 7 == 0, "x").otherwise(F.col("key_type")).alias("key_type"),
        F.md5((F.col("cents") + F.when(F.col("o_custkey") % 11 == 0, 1).otherwise(0)).cast("string")).alias("value_hash"),
    )
    return source, target


@query(
    "validate_sample",
    "J8",
    """SELECT concat('order:', o_orderkey) AS key, o_orderpriority[1] AS key_type, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_custkey % 7 = 0 THEN 'type_mismatch'
    WHEN o_custkey % 11 = 0 THEN 'value_mismatch' ELSE 'match' END AS status FROM orders""",
)
def _validate(t: Tables):
    return C.validate_sample(*migration_sides(t))


@query(
    "sampled_validation_summary",
    "J8",
    f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_custkey % 7 = 0 THEN 'type_mismatch' WHEN o_custkey % 11 = 0 THEN 'value_mismatch' ELSE 'match' END AS status
    FROM orders WHERE CAST(concat('0x', substr(md5(concat('order:', o_orderkey, '#7')), 1, 8)) AS BIGINT) < {1 << 30}) GROUP BY 1""",
)
def _sampled(t: Tables):
    source, target = migration_sides(t)
    return C.validate_sample(C.sample_keys(source, 0.25), target).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def cache_spans(t: Tables):
    inst = F.concat(F.lit("i"), (F.col("user_id") % 5).cast("string"))
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("span_id"),
        F.when(kind != "view", F.concat(inst, F.lit(":"), (F.col("event_id") % 200).cast("string"))).alias("cache_key"),
        F.when(kind.isin("click", "view"), inst).alias("instance"),
        F.when(kind.isin("purchase", "click"), True).when(kind != "error", False).alias("hit"),
        kind.alias("kind"),
        F.col("value"),
    )


@query(
    "correlate_spans",
    "J7",
    """WITH s AS (SELECT event_id AS span_id, event_type AS kind, value, CASE WHEN event_type <> 'view' THEN concat('i', user_id % 5, ':', event_id % 200) END AS cache_key, concat('i', user_id % 5) AS inst,
        CASE WHEN event_type IN ('purchase','click') THEN true WHEN event_type <> 'error' THEN false END AS hit FROM events),
      k AS (SELECT cache_key, CAST(floor(min(value)) AS INTEGER) AS ttl FROM s WHERE kind = 'purchase' GROUP BY 1),
      i AS (SELECT inst, CAST(count(*) AS DOUBLE)/100000 AS th, CASE WHEN inst = 'i2' THEN 'building' ELSE 'ready' END AS st FROM s WHERE inst <> 'i4' GROUP BY 1)
    SELECT span_id, s.cache_key, s.inst AS instance, hit, CASE WHEN s.cache_key IS NOT NULL THEN k.ttl IS NOT NULL END AS exists_now,
      CASE WHEN s.cache_key IS NOT NULL THEN coalesce(k.ttl, -2) END AS ttl_now_s, th AS threshold, st AS index_state,
      CASE WHEN s.cache_key IS NULL AND NOT hit THEN 'miss-below-threshold' WHEN s.cache_key IS NULL THEN 'no-key' WHEN NOT hit AND k.ttl IS NOT NULL THEN 'cold-miss' WHEN NOT hit THEN 'uncached'
        WHEN hit AND k.ttl IS NULL THEN 'gone-since' WHEN hit THEN 'present' WHEN k.ttl IS NOT NULL THEN 'key-present' ELSE 'key-absent' END AS explanation,
      coalesce(st <> 'ready', false) AS degraded_index
    FROM s LEFT JOIN k ON k.cache_key = s.cache_key LEFT JOIN i ON i.inst = s.inst""",
)
def _spans(t: Tables):
    spans = cache_spans(t)
    keys = spans.where(F.col("kind") == "purchase").groupBy("cache_key").agg(F.floor(F.min("value")).cast("int").alias("ttl_s"))
    inst = F.concat(F.lit("i"), (F.col("user_id") % 5).cast("string"))
    instances = (
        t.events.where(F.col("user_id") % 5 != 4)
        .groupBy(inst.alias("instance"))
        .agg((F.count(F.lit(1)) / 100_000).alias("threshold"))
        .withColumn("index_state", F.when(F.col("instance") == "i2", "building").otherwise("ready"))
    )
    return C.correlate_spans(spans.drop("kind", "value"), keys, instances)


def signals(t: Tables):
    kind = F.element_at(F.array(*[F.lit(s) for s in ("lfu", "idletime", "cardinality", "composite")]), (F.col("line_number") % 4 + 1).cast("int"))
    return t.key.select(
        "connection_id", kind.alias("signal"), (F.floor(F.col("order_key") / 11) * 11).alias("captured_ms"), "key", "memory_bytes"
    )


_SIG = """s AS (SELECT connection_id, ['lfu','idletime','cardinality','composite'][line_number % 4 + 1] AS signal, order_key//11*11 AS captured_ms, key, memory_bytes FROM v_key)"""


@query(
    "latest_signal_batch",
    "J23",
    f"""WITH {_SIG} SELECT connection_id, signal, captured_ms, key, memory_bytes FROM (SELECT *, max(captured_ms) OVER (PARTITION BY connection_id, signal) AS m FROM s) WHERE captured_ms = m""",
)
def _batch(t: Tables):
    return C.latest_batch(signals(t))


@query(
    "current_composites",
    "J23",
    f"""WITH {_SIG} SELECT connection_id, signal, captured_ms, key, memory_bytes FROM (SELECT *, max(captured_ms) OVER (PARTITION BY connection_id) AS a,
      max(captured_ms) FILTER (signal='composite') OVER (PARTITION BY connection_id) AS m FROM s) WHERE signal = 'composite' AND captured_ms = m AND m = a""",
)
def _composites(t: Tables):
    return C.current_composites(signals(t))


@query(
    "live_instances",
    "J27",
    """WITH s AS (SELECT concat(connection_id, metric) AS instance, arg_max(struct_pack(ts := ts_ms, h := cents, m := id), (ts_ms, id)) AS s FROM v_metric GROUP BY 1),
      r AS (SELECT DISTINCT concat(connection_id, metric) AS instance, metric AS kind FROM v_metric), h AS (SELECT DISTINCT concat(connection_id, metric) AS instance FROM v_metric WHERE value > 480)
    SELECT r.instance, kind, h.instance IS NOT NULL AS alive, s.ts AS sampled_ms, s.h AS hits, s.m AS misses FROM r LEFT JOIN s USING (instance) LEFT JOIN h ON h.instance = r.instance""",
)
def _live(t: Tables):
    rows = t.metric.withColumn("instance", F.concat("connection_id", "metric"))
    registry = rows.select("instance", F.col("metric").alias("kind")).distinct()
    samples = rows.select("instance", "ts_ms", "id", F.col("cents").alias("hits"), F.col("id").alias("misses"))
    return C.live_instances(registry, rows.where(F.col("value") > 480).select("instance"), samples)


@query(
    "tool_effectiveness",
    "J22",
    """WITH o AS (SELECT category AS tool, count(*) FILTER (result='hit') AS h, count(*) FILTER (result<>'hit') AS m FROM v_sim GROUP BY 1)
    SELECT tool, h/(h+m) AS hit_rate, CASE WHEN tool = 'cat0' THEN CAST(1200 AS BIGINT) ELSE CAST(7200 AS BIGINT) END AS effective_ttl_s,
      CASE WHEN h/(h+m) > 0.8 AND tool = 'cat0' THEN 'increase_ttl' WHEN h/(h+m) >= 0.4 THEN 'optimal' ELSE 'decrease_ttl_or_disable' END AS advice FROM o""",
)
def _tools(t: Tables):
    stats = t.sim.groupBy(F.col("category").alias("tool")).agg(
        F.count_if(F.col("result") == "hit").alias("hits"), F.count_if(F.col("result") != "hit").alias("misses")
    )
    policies = stats.where(F.col("tool") == "cat0").select("tool", F.lit(1200).cast("bigint").alias("ttl_s"))
    return C.tool_effectiveness(stats, policies, None, 7200)
