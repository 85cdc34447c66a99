"""Counter, gauge and state series queries."""

from pyspark.sql import functions as F

from fleetscope.catalog.latency_queries import index_snapshots
from fleetscope.catalog.registry import query
from fleetscope.catalog.views import ORIGIN_MS, Tables
from fleetscope.operators import timeseries as S

HOUR, DAY = 3_600_000, 86_400_000


def polls(t: Tables):
    """Last counter value of every command per three hours: one poll each."""
    at = (F.floor(F.col("ts_ms") / (3 * HOUR)) * (3 * HOUR)).alias("captured_ms")
    return (
        t.counter.groupBy("connection_id", at, F.col("metric").alias("command"))
        .agg(F.max_by("total", F.struct("ts_ms", "id")).alias("calls"))
        .withColumn("usec", F.col("calls") * 3)
    )


POLLS = """s AS (SELECT connection_id, ts_ms//10800000*10800000 AS captured_ms, metric AS command, arg_max(total, (ts_ms, id)) AS calls,
  arg_max(total, (ts_ms, id))*3 AS usec FROM v_counter GROUP BY 1,2,3),
  pp AS (SELECT connection_id, captured_ms, lag(captured_ms) OVER (PARTITION BY connection_id ORDER BY captured_ms) AS prev_ms
    FROM (SELECT DISTINCT connection_id, captured_ms FROM s)),
  j AS (SELECT s.*, pp.prev_ms, s.calls-b.calls AS cd, s.usec-b.usec AS ud FROM s JOIN pp USING (connection_id, captured_ms)
    JOIN s b ON b.connection_id = s.connection_id AND b.captured_ms = pp.prev_ms AND b.command = s.command),
  d AS (SELECT connection_id, captured_ms, command, cd AS calls_delta, ud AS usec_delta, captured_ms-prev_ms AS interval_ms FROM
    (SELECT *, bool_or(cd < 0 OR ud < 0) OVER (PARTITION BY connection_id, captured_ms) AS reset FROM j) WHERE NOT reset AND (cd <> 0 OR ud <> 0))"""


@query("counter_deltas", "W2", f"WITH {POLLS} SELECT * FROM d")
def _deltas(t: Tables):
    return S.counter_deltas(polls(t))


@query(
    "counter_rates",
    "P17 W2",
    f"""WITH {POLLS} SELECT *, CASE WHEN interval_ms > 0 THEN calls_delta/(interval_ms/CAST(1000 AS DOUBLE)) ELSE 0 END AS ops_per_sec,
    CASE WHEN calls_delta > 0 THEN usec_delta/calls_delta ELSE 0 END AS avg_usec FROM d""",
)
def _rates(t: Tables):
    return S.delta_rates(S.counter_deltas(polls(t)))


@query(
    "clamped_deltas",
    "W3",
    """SELECT connection_id, metric, ts_ms, id, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY connection_id, metric ORDER BY ts_ms, id), total)) AS delta FROM v_counter""",
)
def _clamped(t: Tables):
    return S.clamped_deltas(t.counter, ["connection_id", "metric"], ["ts_ms", "id"], "total").drop("total")


@query(
    "cpu_utilization",
    "W4",
    """SELECT connection_id, ts_ms, id, u*10/e*100 AS cpu_pct FROM (SELECT *, total - lag(total) OVER w AS u, ts_ms - lag(ts_ms) OVER w AS e FROM v_counter WHERE metric = 'click'
    WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms, id)) WHERE u >= 0 AND e > 0""",
)
def _cpu(t: Tables):
    readings = t.counter.where(F.col("metric") == "click").withColumnRenamed("total", "cpu_centis")
    return S.cpu_utilization(readings).select("connection_id", "ts_ms", "id", "cpu_pct")


BASELINE = """b AS (SELECT connection_id, metric, ts_ms, id, cents, n AS samples, s/n AS mean, CASE WHEN n < 2 THEN 0 ELSE sqrt(CAST(n*q-s*s AS DOUBLE))/n END AS stddev, n >= 30 AS ready
  FROM (SELECT *, count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS s, CAST(sum(cents*cents) OVER w AS BIGINT) AS q FROM v_metric
    WINDOW w AS (PARTITION BY connection_id, metric ORDER BY ts_ms, id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)))"""


@query(
    "rolling_baseline",
    "W5",
    f"""WITH {BASELINE} SELECT connection_id, metric, ts_ms, id, cents, samples, mean, stddev, CASE WHEN stddev = 0 THEN 0 ELSE (cents-mean)/stddev END AS z, ready FROM b""",
)
def _baseline(t: Tables):
    return S.rolling_baseline(t.metric.drop("value"), ["connection_id", "metric"], ["ts_ms", "id"], "cents")


@query(
    "metric_warmup",
    "A39",
    """SELECT connection_id, metric, count(*) AS samples, min(cents) AS min_units, max(cents) AS max_units, arg_max(cents, (ts_ms, id)) AS latest_units,
      CAST(sum(cents) AS DOUBLE)/count(*) AS mean, sqrt(CAST(count(*)*sum(cents*cents)-sum(cents)*sum(cents) AS DOUBLE))/count(*) AS stddev, count(*) >= 30 AS ready,
      least(CAST(100 AS DOUBLE), count(*)/30*100) AS ready_pct FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, metric ORDER BY ts_ms DESC, id DESC) AS rn FROM v_metric)
    WHERE rn <= 300 GROUP BY 1,2""",
)
def _warmup(t: Tables):
    return S.buffer_warmup(t.metric, ["connection_id", "metric"], ["ts_ms", "id"], "cents")


@query(
    "latest_samples",
    "W1",
    "SELECT connection_id, metric, ts_ms, id FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, metric ORDER BY ts_ms DESC, id DESC) AS rn FROM v_metric) WHERE rn <= 24",
)
def _latest(t: Tables):
    return S.latest_n_per_group(t.metric, ["connection_id", "metric"], ["ts_ms", "id"], 24).select(
        "connection_id", "metric", "ts_ms", "id"
    )


@query(
    "downsampled_series",
    "W10",
    """WITH r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY connection_id, metric) AS n FROM v_metric
        WINDOW w AS (PARTITION BY connection_id, metric ORDER BY ts_ms, id)),
      k AS (SELECT DISTINCT connection_id, metric, CAST(floor(g.range*(n/CAST(100 AS DOUBLE))) AS BIGINT) AS i FROM (SELECT DISTINCT connection_id, metric, n FROM r), range(99) g WHERE n > 100)
    SELECT r.connection_id, r.metric, r.ts_ms, r.id FROM r LEFT JOIN k ON k.connection_id = r.connection_id AND k.metric = r.metric AND k.i = r.i
    WHERE n <= 100 OR k.i IS NOT NULL OR r.i = n - 1""",
)
def _downsample(t: Tables):
    rows = t.metric.select("connection_id", "metric", "ts_ms", "id")
    return S.downsample(rows, ["connection_id", "metric"], ["ts_ms", "id"], 100)


@query(
    "capacity_forecast",
    "W11",
    f"""WITH g AS (SELECT connection_id, metric, count(*) AS points, sum(CAST(x AS HUGEINT)) AS sx, sum(CAST(y AS HUGEINT)) AS sy, sum(CAST(x AS HUGEINT)*y) AS sxy, sum(CAST(x AS HUGEINT)*x) AS sxx,
        min(x) AS x1, max(x) AS x2, arg_max(y, (x, id)) AS cur FROM (SELECT *, ts_ms-{ORIGIN_MS + 10 * DAY} AS x, cents AS y FROM v_metric WHERE ts_ms BETWEEN {ORIGIN_MS + 10 * DAY} AND {ORIGIN_MS + 25 * DAY}) GROUP BY 1,2),
      f AS (SELECT *, CASE WHEN points*sxx - sx*sx = 0 THEN 0 ELSE CAST(CAST(points*sxy - sx*sy AS VARCHAR) AS DOUBLE)/CAST(CAST(points*sxx - sx*sx AS VARCHAR) AS DOUBLE) END AS slope FROM g),
      h AS (SELECT *, (CAST(sy AS DOUBLE) - slope*CAST(sx AS DOUBLE))/points AS ic FROM f), p AS (SELECT *, slope*x1+ic AS a, slope*x2+ic AS b FROM h),
      q AS (SELECT *, CASE WHEN a <> 0 THEN (b-a)/abs(a)*100 WHEN b <> 0 THEN 100 ELSE 0 END AS gp FROM p)
    SELECT connection_id, metric, points, cur AS current_units, NOT (points >= 3 AND x2-x1 >= 1800000) AS insufficient, slope*3600000 AS growth_per_hour, gp AS growth_pct,
      CASE WHEN gp > 5 THEN 'rising' WHEN gp < -5 THEN 'falling' ELSE 'stable' END AS trend,
      CASE WHEN cur >= 40000 THEN 0 WHEN gp > 5 AND slope > 0 THEN (40000-cur)/slope END AS time_to_limit_ms FROM q""",
)
def _forecast(t: Tables):
    return S.forecast(t.metric.withColumnRenamed("cents", "units"), ORIGIN_MS + 10 * DAY, ORIGIN_MS + 25 * DAY, 40_000.0)


def role_polls(t: Tables):
    role = F.when(F.col("id") % 11 == 0, "unknown").when(F.floor(F.col("id") / 97) % 3 == 0, "slave").otherwise("master")
    return t.metric.select("connection_id", "ts_ms", "id", role.alias("role"))


ROLES = """r AS (SELECT connection_id, ts_ms, id, CASE WHEN id % 11 = 0 THEN NULL WHEN (id//97) % 3 = 0 THEN 'replica' ELSE 'master' END AS role FROM v_metric)"""


@query(
    "role_transitions",
    "W13",
    f"""WITH {ROLES} SELECT connection_id, ts_ms, id, CASE WHEN role = 'replica' THEN 'demoted' ELSE 'promoted' END AS transition,
    CASE WHEN role = 'replica' THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT *, lag(role) OVER (PARTITION BY connection_id ORDER BY ts_ms, id) AS p FROM r WHERE role IS NOT NULL) WHERE p <> role""",
)
def _roles(t: Tables):
    return S.role_transitions(role_polls(t))


@query(
    "cluster_state_transitions",
    "W13",
    """SELECT connection_id, ts_ms, id, prev_state, state, CASE WHEN state <> 'ok' THEN 'critical' ELSE 'info' END AS severity FROM
    (SELECT *, lag(state) OVER (PARTITION BY connection_id ORDER BY ts_ms, id) AS prev_state FROM (SELECT *, CASE WHEN (id//53) % 4 = 0 THEN 'fail' ELSE 'ok' END AS state FROM v_metric)) WHERE prev_state <> state""",
)
def _states(t: Tables):
    state = F.when(F.floor(F.col("id") / 53) % 4 == 0, "fail").otherwise("ok")
    return S.state_transitions(t.metric.select("connection_id", "ts_ms", "id", state.alias("state")))


def replication_polls(t: Tables):
    run = F.floor(F.col("id") / 60)
    return t.metric.select(
        "connection_id",
        "ts_ms",
        "id",
        F.when(F.col("connection_id").isin("c0", "c1"), "master").otherwise("replica").alias("role"),
        F.concat(F.lit("r"), F.floor(F.col("id") / 120).cast("string")).alias("replid"),
        ((F.col("id") % 120) * 1000).alias("offset"),
        F.when(run % 3 == 1, 0).otherwise(F.col("cents")).alias("keys"),
        (F.col("id") % 240).alias("uptime_s"),
        (F.col("id") % 13 == 0).alias("loading"),
    )


REPL = """r AS (SELECT connection_id, ts_ms, id, CASE WHEN connection_id IN ('c0','c1') THEN 'master' ELSE 'replica' END AS role, concat('r', id//120) AS replid, (id % 120)*1000 AS off,
  CASE WHEN (id//60) % 3 = 1 THEN 0 ELSE cents END AS keys, id % 240 AS up FROM v_metric WHERE id % 13 <> 0),
  l AS (SELECT *, lag(role) OVER w AS prole, lag(replid) OVER w AS preplid, lag(off) OVER w AS poff, lag(keys) OVER w AS pkeys, lag(up) OVER w AS pup FROM r WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms, id))"""


@query(
    "data_loss",
    "W14",
    f"""WITH {REPL}, k AS (SELECT *, CASE WHEN prole = 'master' AND role = 'master' AND pkeys > 0 AND keys = 0 AND (replid <> preplid OR up < pup OR off < poff) THEN 'primary_restarted_empty'
      WHEN prole = 'replica' AND role = 'replica' AND replid <> preplid AND pkeys > 0 AND keys <= pkeys*CAST(0.1 AS DOUBLE) THEN 'replica_wiped' END AS kind FROM l)
    SELECT connection_id, ts_ms, id, kind, pkeys AS keys_before, keys FROM k WHERE kind IS NOT NULL""",
)
def _loss(t: Tables):
    return S.data_loss(replication_polls(t))


@query(
    "new_log_entries",
    "W15",
    """WITH p AS (SELECT connection_id, unnest([ts_ms//3600000, ts_ms//3600000+1]) AS captured_ms, id % 2500 AS id, value FROM v_log),
      m AS (SELECT connection_id, captured_ms, max(id) AS top FROM p GROUP BY 1,2), l AS (SELECT *, lag(top) OVER (PARTITION BY connection_id ORDER BY captured_ms) AS last FROM m)
    SELECT p.connection_id, p.captured_ms, p.id, p.value FROM p JOIN l USING (connection_id, captured_ms) WHERE last IS NULL OR top < last OR p.id > last""",
)
def _new_entries(t: Tables):
    hour = F.floor(F.col("ts_ms") / HOUR)
    polled = t.log.select(
        "connection_id", F.explode(F.array(hour, hour + 1)).alias("captured_ms"), (F.col("id") % 2500).alias("id"), "value"
    )
    return S.new_log_entries(polled)


@query(
    "topology_burst",
    "W16",
    f"""WITH {POLLS}, c AS (SELECT * FROM d WHERE command = 'click'), m AS (SELECT connection_id, quantile_cont(calls_delta, 0.5) AS median,
      max(calls_delta) FILTER (captured_ms BETWEEN {ORIGIN_MS + 5 * DAY} AND {ORIGIN_MS + 8 * DAY}) AS peak FROM c GROUP BY 1)
    SELECT connection_id, median, peak, coalesce(peak > greatest(CAST(10 AS DOUBLE), median*2), false) AS burst FROM m""",
)
def _burst(t: Tables):
    deltas = S.counter_deltas(polls(t)).where(F.col("command") == "click")
    return S.topology_burst(deltas, ORIGIN_MS + 5 * DAY, ORIGIN_MS + 8 * DAY)


@query(
    "config_changes",
    "W17",
    """SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY connection_id, name ORDER BY captured_ms) AS old_value FROM
    (SELECT connection_id, ts_ms//21600000 AS captured_ms, metric AS name, CAST(max(id)//400 AS VARCHAR) AS value FROM v_metric GROUP BY 1,2,3)) WHERE old_value <> value""",
)
def _config(t: Tables):
    settings = t.metric.groupBy(
        "connection_id", F.floor(F.col("ts_ms") / (6 * HOUR)).alias("captured_ms"), F.col("metric").alias("name")
    ).agg(F.floor(F.max("id") / 400).cast("string").alias("value"))
    return S.config_changes(settings)


@query(
    "acl_changes",
    "W17",
    """WITH r AS (SELECT connection_id, ts_ms//21600000 AS captured_ms, concat('u', id % 37) AS username, min(metric) AS rule FROM v_metric GROUP BY 1,2,3),
      p AS (SELECT connection_id, captured_ms, lag(captured_ms) OVER (PARTITION BY connection_id ORDER BY captured_ms) AS prev_ms FROM (SELECT DISTINCT connection_id, captured_ms FROM r)),
      a AS (SELECT r.* FROM r JOIN p USING (connection_id, captured_ms) WHERE prev_ms IS NOT NULL),
      b AS (SELECT r.connection_id, p.captured_ms, username, rule AS old FROM r JOIN p ON p.connection_id = r.connection_id AND p.prev_ms = r.captured_ms)
    SELECT * FROM (SELECT connection_id, captured_ms, username, CASE WHEN old IS NULL THEN 'added' WHEN rule IS NULL THEN 'removed' WHEN rule <> old THEN 'changed' END AS change
      FROM a FULL JOIN b USING (connection_id, captured_ms, username)) WHERE change IS NOT NULL""",
)
def _acl(t: Tables):
    rules = t.metric.groupBy(
        "connection_id",
        F.floor(F.col("ts_ms") / (6 * HOUR)).alias("captured_ms"),
        F.concat(F.lit("u"), (F.col("id") % 37).cast("string")).alias("username"),
    ).agg(F.min("metric").alias("rule"))
    return S.acl_changes(rules)


@query(
    "index_growth",
    "W18",
    """WITH g AS (SELECT connection_id, concat('idx', id % 3) AS index_name, count(*) AS samples, arg_min(cents, (ts_ms, id)) AS first_docs, arg_max(cents, (ts_ms, id)) AS last_docs FROM v_metric GROUP BY 1,2),
      d AS (SELECT *, last_docs-first_docs AS delta, CASE WHEN first_docs > 0 THEN (last_docs-first_docs)/first_docs*100 ELSE 0 END AS delta_pct FROM g WHERE samples >= 3)
    SELECT *, CASE WHEN abs(delta_pct) < 0.1 THEN 'flat' WHEN delta > 0 THEN 'up' ELSE 'down' END AS trend FROM d""",
)
def _growth(t: Tables):
    snapshots = t.metric.select(
        "connection_id",
        F.concat(F.lit("idx"), (F.col("id") % 3).cast("string")).alias("index_name"),
        "ts_ms",
        "id",
        F.col("cents").alias("num_docs"),
    )
    return S.index_growth(snapshots)


@query(
    "index_history",
    "W12",
    f"""SELECT connection_id, concat('idx', id % 3) AS index_name, ts_ms, CASE WHEN id % 7 < 3 THEN CAST(100 AS DOUBLE) ELSE CAST(id % 100 AS DOUBLE) END AS percent_indexed
    FROM v_metric WHERE id % 3 = 1 AND connection_id = 'c2' AND ts_ms BETWEEN {ORIGIN_MS + DAY} AND {ORIGIN_MS + 9 * DAY}""",
)
def _history(t: Tables):
    return S.series_between(
        index_snapshots(t), {"index_name": "idx1", "connection_id": "c2"}, ORIGIN_MS + DAY, ORIGIN_MS + 9 * DAY
    )


@query(
    "client_saturation",
    "T4",
    """SELECT connection_id, ts_ms, id, level FROM (SELECT *, lag(level) OVER (PARTITION BY connection_id ORDER BY ts_ms, id) AS p FROM
    (SELECT *, CASE WHEN cents/20000 >= 0.95 THEN 2 WHEN cents/20000 >= 0.80 THEN 1 ELSE 0 END AS level FROM v_metric)) WHERE level > coalesce(p, 0)""",
)
def _saturation(t: Tables):
    readings = t.metric.select(
        "connection_id", "ts_ms", "id", F.col("cents").alias("clients"), F.lit(20_000).alias("max_clients")
    )
    return S.client_saturation(readings).select("connection_id", "ts_ms", "id", "level")


@query(
    "up_down_edges",
    "T20",
    """SELECT connection_id, ts_ms, id, CASE WHEN up THEN 'up' ELSE 'down' END AS edge FROM (SELECT *, lag(up) OVER (PARTITION BY connection_id ORDER BY ts_ms, id) AS p FROM
    (SELECT connection_id, ts_ms, id, metric <> 'error' AS up FROM v_metric)) WHERE up <> coalesce(p, true)""",
)
def _edges(t: Tables):
    return S.up_down_edges(t.metric.select("connection_id", "ts_ms", "id", (F.col("metric") != "error").alias("up")))
