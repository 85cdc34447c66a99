"""Latency and trace queries."""

from pyspark.sql import functions as F

from fleetscope.catalog.registry import query
from fleetscope.catalog.views import ORIGIN_MS, Tables
from fleetscope.operators import latency as L

DAY = 86_400_000
START, END = ORIGIN_MS + DAY, ORIGIN_MS + 29 * DAY
BUCKET = """CASE WHEN verb = 'FT.SEARCH' THEN concat('FT.SEARCH:', key) WHEN verb IN ('GET','MGET') THEN 'read'
  WHEN verb IN ('SET','HSET','HMSET','HSETNX') THEN 'write' END"""
ENTRIES = f"e AS (SELECT *, {BUCKET} AS bucket FROM v_log WHERE log_type = 'slow' AND ts_ms >= {START} AND ts_ms < {END} AND {BUCKET} IS NOT NULL)"
_Q = "quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99"


@query(
    "latency_profile",
    "A19 P6",
    f"""WITH {ENTRIES} SELECT connection_id, bucket, count(*) AS n, {_Q}, starts_with(bucket, 'FT.SEARCH:') AND quantile_disc(value, 0.5) > 10000 AS unhealthy
    FROM e GROUP BY 1,2""",
)
def _profile(t: Tables):
    return L.latency_profile(t.log, START, END)


@query(
    "latency_profile_sketch",
    "A19",
    f"WITH {ENTRIES} SELECT connection_id, bucket, count(*) AS n, true AS p50_within, true AS p95_within FROM e GROUP BY 1,2",
)
def _profile_sketch(t: Tables):
    """Sketched quantiles and whether their true rank is within three percent and one row of the asked one."""
    keys = ["connection_id", "bucket"]
    sketch = L.latency_profile_sketch(t.log, START, END)
    entries = L.latency_entries(t.log, START, END).select(*keys, "value")
    ranked = entries.join(sketch, keys).groupBy(*keys, "n").agg(
        *[(F.count_if(F.col("value") <= F.col(p)) / F.count(F.lit(1))).alias(p) for p in ("p50", "p95")]
    )
    within = lambda p, share: (F.abs(F.col(p) - share) <= F.lit(0.03) + F.lit(1.0) / F.col("n")).alias(f"{p}_within")
    return ranked.select(*keys, "n", within("p50", 0.5), within("p95", 0.95))


@query(
    "latency_trend",
    "A20",
    f"WITH {ENTRIES} SELECT bucket, {START} + (ts_ms-{START})//21600000*21600000 AS bin_ms, count(*) AS n, {_Q} FROM e GROUP BY 1,2",
)
def _trend(t: Tables):
    return L.latency_trend(t.log, START, END, 21_600_000)


def histogram(t: Tables, keys=()):
    return t.log.groupBy(
        *keys,
        F.col("verb").alias("command"),
        F.pow(F.lit(2.0), F.floor(F.log2(F.col("value") + 1.0))).cast("bigint").alias("bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))


_H = "h AS (SELECT verb AS command, CAST(pow(2, floor(log2(value+1))) AS BIGINT) AS bucket, count(*) AS n FROM v_log GROUP BY 1,2)"


@query(
    "histogram_percentiles",
    "A21",
    f"""WITH {_H}, c AS (SELECT *, sum(n) OVER (PARTITION BY command ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY command) AS tot FROM h)
    SELECT command, CAST(max(tot) AS BIGINT) AS calls, min(bucket) FILTER (cum >= tot*0.5) AS p50, min(bucket) FILTER (cum >= tot*0.95) AS p95,
    min(bucket) FILTER (cum >= tot*0.99) AS p99 FROM c GROUP BY 1""",
)
def _histogram(t: Tables):
    return L.histogram_percentiles(histogram(t))


@query(
    "histogram_top_commands",
    "A22",
    f"WITH {_H} SELECT command, CAST(sum(n) AS BIGINT) AS calls FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
def _histogram_top(t: Tables):
    return L.histogram_top_commands(histogram(t), 3)


@query(
    "latest_latency_events",
    "A22",
    "SELECT metric AS event, max(ts_ms) AS ts_ms, arg_max(cents, (ts_ms, id)) AS latest_value, max(cents) AS max_value FROM v_metric GROUP BY 1",
)
def _latest(t: Tables):
    return L.latest_latency_events(
        t.metric.select(F.col("metric").alias("event"), "ts_ms", "id", F.col("cents").alias("value"))
    )


def index_snapshots(t: Tables):
    return t.metric.select(
        "connection_id",
        F.concat(F.lit("idx"), (F.col("id") % 3).cast("string")).alias("index_name"),
        "ts_ms",
        F.when(F.col("id") % 7 < 3, 100.0).otherwise((F.col("id") % 100).cast("double")).alias("percent_indexed"),
    )


SNAPSHOTS = """x AS (SELECT connection_id, concat('idx', id % 3) AS index_name, ts_ms,
  CASE WHEN id % 7 < 3 THEN CAST(100 AS DOUBLE) ELSE CAST(id % 100 AS DOUBLE) END AS pct FROM v_metric)"""


@query(
    "annotate_indexing",
    "J6",
    f"""WITH {ENTRIES}, {SNAPSHOTS}, s AS (SELECT * FROM e WHERE starts_with(bucket, 'FT.SEARCH:')),
      r AS (SELECT *, row_number() OVER (PARTITION BY connection_id, bucket ORDER BY value) AS rn, count(*) OVER (PARTITION BY connection_id, bucket) AS n FROM s),
      c AS (SELECT connection_id, bucket, max(value) FILTER (rn = least(CAST(floor(n*(1-CAST(0.1 AS DOUBLE))) AS BIGINT), n-1)+1) AS cut FROM r GROUP BY 1,2),
      w AS (SELECT connection_id, concat('FT.SEARCH:', index_name) AS bucket, ts_ms AS st, pct FROM x WHERE ts_ms >= {START} AND ts_ms < {END}),
      j AS (SELECT t.connection_id, t.bucket, w.st, w.pct FROM (SELECT s.* FROM s JOIN c USING (connection_id, bucket) WHERE value >= cut) t
        ASOF JOIN w ON t.connection_id = w.connection_id AND t.bucket = w.bucket AND t.ts_ms >= w.st)
    SELECT connection_id, bucket, min(st) AS since_ms, count(*) AS affected FROM j WHERE pct < 100 GROUP BY 1,2""",
)
def _indexing(t: Tables):
    return L.annotate_indexing(t.log, index_snapshots(t), START, END)


@query(
    "trace_summary",
    "A24",
    """SELECT * FROM (SELECT trace_id, min(start_ms) AS start_ms, count(*) AS spans, count(*) FILTER (scope IN ('click','view')) AS tracked_spans,
      bool_or(status = 2) AS has_error, max(scope) FILTER (parent_id IS NULL) AS root_name, coalesce(max(service) FILTER (parent_id IS NULL), max(service)) AS service,
      coalesce(max(duration_ns) FILTER (parent_id IS NULL), (max(start_ms + duration_ns//1000000) - min(start_ms))*1000000) AS duration_ns
    FROM v_span GROUP BY 1 HAVING count(*) FILTER (service = 'svc3') > 0) WHERE start_ms >= 1704412800000""",
)
def _traces(t: Tables):
    return L.trace_summary(t.span, ["click", "view"], start_ms=1_704_412_800_000, service="svc3")
