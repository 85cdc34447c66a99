"""Parsing, sink and scalar-function queries."""

from pyspark.sql import functions as F

from fleetscope.catalog.registry import query
from fleetscope.catalog.views import ORIGIN_MS, Tables
from fleetscope.functions import fleet, identity, keys, scoring
from fleetscope.operators import topology
from fleetscope.sources import captures, dumps, otlp, pairs, sinks

DAY = 86_400_000


def capture_lines(t: Tables):
    """Log entries as captured text; some lines carry escapes, some do not parse."""
    note = F.when(F.col("log_type") == "slow", F.lit(' "say \\"hi\\" \\\\ bye"')).otherwise(F.lit(""))
    stamp = F.format_string("%d.%03d", F.floor(F.col("ts_ms") / 1000), F.col("ts_ms") % 1000)
    line = F.concat(
        stamp, F.lit(" [0 "), "client_addr", F.lit('] "'), F.lower("verb"), F.lit('" "'), "key", F.lit('"'), note
    )
    broken = F.concat(stamp, F.lit(" [x "), "client_addr", F.lit("] no quotes"))
    return t.log.select(
        "id", F.when(F.col("log_type") == "large-request", broken).otherwise(line).alias("line")
    )


PARSED = """p AS (SELECT id, ts_ms AS ts, concat(ts_ms//1000, '.', lpad(CAST(ts_ms % 1000 AS VARCHAR), 3, '0')) AS ts_raw, 0 AS db, client_addr AS addr, verb AS cmd,
  CASE WHEN log_type = 'slow' THEN concat(key, ' say "hi" \\ bye') ELSE key END AS args, key FROM v_log WHERE log_type <> 'large-request')"""


@query("parse_capture", "S2", f"WITH {PARSED} SELECT id, ts, ts_raw, db, addr, cmd, args, key FROM p")
def _parse(t: Tables):
    parsed = captures.parse_capture(capture_lines(t))
    return parsed.withColumn("args", F.array_join("args", " ")).drop("line")


@query(
    "filter_capture",
    "S3",
    f"""WITH {PARSED} SELECT id, ts, cmd, key FROM p WHERE cmd = 'GET' AND contains(addr, '10.0.1') AND regexp_full_match(key, 'click:1.:.*') AND ts >= {ORIGIN_MS + DAY}""",
)
def _filter(t: Tables):
    parsed = captures.parse_capture(capture_lines(t))
    return captures.filter_capture(parsed, "get", "10.0.1", "click:1?:*", after=ORIGIN_MS + DAY).select("id", "ts", "cmd", "key")


@query(
    "export_capture_records",
    "S4",
    f"""WITH {PARSED} SELECT id, concat_ws(',', ts, ts_raw, db, addr, cmd, CASE WHEN contains(args, '"') THEN concat('"', replace(args, '"', '""'), '"') ELSE args END, key) AS record FROM p""",
)
def _export(t: Tables):
    return captures.csv_records(captures.parse_capture(capture_lines(t))).select("id", "record")


@query(
    "redacted_arguments",
    "S17",
    """SELECT id, CASE verb WHEN 'SET' THEN concat_ws(' ', verb, key, '<redacted>', 'b', 'c', 'd') WHEN 'HSET' THEN concat_ws(' ', verb, key, 'a', '<redacted>', 'c', '<redacted>')
    ELSE concat_ws(' ', array_to_string(args, ' '), 'a', 'b', 'c', 'd') END AS line FROM v_log""",
)
def _redact(t: Tables):
    longer = F.concat("args", F.array(*[F.lit(x) for x in "abcd"]))
    return t.log.select("id", F.array_join(captures.redact_values(longer), " ").alias("line"))


def span_requests(t: Tables):
    """One export request per trace (eight spans)."""
    value = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    attribute = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
    null_text, null_bool, null_double = F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("double")
    attributes = F.array(
        attribute("cache.key", value(stringValue=F.concat(F.lit("k"), F.col("span_id").cast("string")), boolValue=null_bool, doubleValue=null_double, intValue=null_text)),
        attribute("cache.hit", value(stringValue=null_text, boolValue=F.col("status") == 1, doubleValue=null_double, intValue=null_text)),
        attribute("tokens", value(stringValue=null_text, boolValue=null_bool, doubleValue=null_double, intValue=(F.col("span_id") % 100).cast("string"))),
    )
    start = F.col("start_ms") * 1_000_000 + 7
    span = F.struct(
        F.format_string("%032x", F.col("trace_id") + 1).alias("traceId"),
        F.format_string("%016x", F.col("span_id") + 1).alias("spanId"),
        F.when(F.col("parent_id").isNull(), "0000000000000000").otherwise(F.format_string("%016x", F.col("parent_id") + 1)).alias("parentSpanId"),
        F.col("scope").alias("name"),
        start.cast("string").alias("startTimeUnixNano"),
        (start + F.col("duration_ns") - F.when(F.col("scope") == "view", F.col("duration_ns") * 2).otherwise(0)).cast("string").alias("endTimeUnixNano"),
        F.struct(F.col("status").alias("code")).alias("status"),
        attributes.alias("attributes"),
    )
    scope = F.when(F.col("scope").isin("click", "error"), F.concat(F.lit("@cache/"), "scope")).otherwise(F.col("scope"))
    per_scope = t.span.groupBy("trace_id", "service", scope.alias("scope_name")).agg(F.collect_list(span).alias("spans"))
    per_service = per_scope.groupBy("trace_id", "service").agg(
        F.collect_list(F.struct(F.struct(F.col("scope_name").alias("name")).alias("scope"), "spans")).alias("scopeSpans")
    )
    resource = F.struct(
        F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))).alias("attributes")
    )
    return per_service.groupBy("trace_id").agg(
        F.to_json(F.struct(F.collect_list(F.struct(resource.alias("resource"), "scopeSpans")).alias("resourceSpans"))).alias("body")
    )


@query(
    "otlp_spans",
    "S5 S6",
    """SELECT lower(lpad(to_hex(trace_id+1), 32, '0')) AS trace_id, lower(lpad(to_hex(span_id+1), 16, '0')) AS span_id, lower(lpad(to_hex(parent_id+1), 16, '0')) AS parent_id, scope AS name, service,
    CASE WHEN scope IN ('click','error') THEN concat('@cache/', scope) ELSE scope END AS scope, start_ms, CASE WHEN scope = 'view' THEN 0 ELSE duration_ns END AS duration_ns, status,
    concat('k', span_id) AS cache_key, CASE WHEN status = 1 THEN 'true' ELSE 'false' END AS cache_hit, CAST(span_id % 100 AS VARCHAR) AS tokens
    FROM v_span WHERE scope IN ('click','error') OR parent_id IS NULL""",
)
def _otlp(t: Tables):
    spans = otlp.otlp_spans(span_requests(t), "@cache/")
    return spans.select(
        "trace_id", "span_id", "parent_id", "name", "service", "scope", "start_ms", "duration_ns", "status",
        F.col("attributes")["cache.key"].alias("cache_key"),
        F.col("attributes")["cache.hit"].alias("cache_hit"),
        F.col("attributes")["tokens"].alias("tokens"),
    )


def info_dumps(t: Tables):
    """One status dump per connection and day, from the counters of that day."""
    day = F.floor(F.col("ts_ms") / DAY)
    per = t.metric.groupBy("connection_id", day.alias("day"), "metric").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cents").alias("usec")
    )
    line = lambda prefix, fmt, *cols: F.concat_ws("\r\n", F.array_sort(F.collect_list(F.format_string(fmt, *cols))))
    stats = line("", "cmdstat_%s:calls=%d,usec=%d,usec_per_call=x,rejected_calls=1,failed_calls=0", F.col("metric"), F.col("calls"), F.col("usec"))
    latency = line("", "latency_percentiles_usec_%s:p50=1.5,p99=%d.25", F.col("metric"), F.col("calls"))
    total = F.sum("calls")
    return per.groupBy("connection_id", "day").agg(
        F.concat(
            F.lit("# Server\r\nredis_version:7.2.4\r\nnote:a:b\r\n\r\n# Clients\r\nconnected_clients:"), total.cast("string"),
            F.lit("\r\n# Memory\r\nmem_fragmentation_ratio:1.25\r\n# Stats\r\nkeyspace_hits:"), F.sum("usec").cast("string"),
            F.lit("\r\nkeyspace_misses:"), total.cast("string"),
            F.lit("\r\n# Replication\r\nrole:slave\r\nmaster_last_io_seconds_ago:"), (total % 7).cast("string"),
            F.lit("\r\n# Commandstats\r\n"), stats, F.lit("\r\n# Latencystats\r\n"), latency,
            F.lit("\r\n# Keyspace\r\ndb0:keys="), total.cast("string"), F.lit(",expires=1,avg_ttl=0\r\ndb1:keys=5,expires=0\r\n"),
        ).alias("text")
    )


INFO = "i AS (SELECT connection_id, ts_ms//86400000 AS day, metric, count(*) AS calls, CAST(sum(cents) AS BIGINT) AS usec FROM v_metric GROUP BY 1,2,3), d AS (SELECT connection_id, day, CAST(sum(calls) AS BIGINT) AS c, CAST(sum(usec) AS BIGINT) AS u FROM i GROUP BY 1,2)"


@query(
    "info_rows",
    "S7",
    f"""WITH {INFO} SELECT connection_id, day, 'server' AS section, 'redis_version' AS name, '7.2.4' AS value FROM d UNION ALL SELECT connection_id, day, 'server', 'note', 'a:b' FROM d
    UNION ALL SELECT connection_id, day, 'clients', 'connected_clients', CAST(c AS VARCHAR) FROM d UNION ALL SELECT connection_id, day, 'memory', 'mem_fragmentation_ratio', '1.25' FROM d
    UNION ALL SELECT connection_id, day, 'stats', 'keyspace_hits', CAST(u AS VARCHAR) FROM d UNION ALL SELECT connection_id, day, 'stats', 'keyspace_misses', CAST(c AS VARCHAR) FROM d
    UNION ALL SELECT connection_id, day, 'replication', 'role', 'slave' FROM d UNION ALL SELECT connection_id, day, 'replication', 'master_last_io_seconds_ago', CAST(c % 7 AS VARCHAR) FROM d
    UNION ALL SELECT connection_id, day, 'commandstats', concat('cmdstat_', metric), concat('calls=', calls, ',usec=', usec, ',usec_per_call=x,rejected_calls=1,failed_calls=0') FROM i
    UNION ALL SELECT connection_id, day, 'latencystats', concat('latency_percentiles_usec_', metric), concat('p50=1.5,p99=', calls, '.25') FROM i
    UNION ALL SELECT connection_id, day, 'keyspace', 'db0', concat('keys=', c, ',expires=1,avg_ttl=0') FROM d UNION ALL SELECT connection_id, day, 'keyspace', 'db1', 'keys=5,expires=0' FROM d""",
)
def _info(t: Tables):
    return dumps.info_rows(info_dumps(t))


@query(
    "commandstats_rows",
    "S8 S9",
    f"""WITH {INFO} SELECT connection_id, day, metric AS command, calls, usec, CAST(0 AS DOUBLE) AS usec_per_call, CAST(1 AS BIGINT) AS rejected_calls, CAST(0 AS BIGINT) AS failed_calls FROM i""",
)
def _commandstats(t: Tables):
    return dumps.commandstats_rows(dumps.info_rows(info_dumps(t)))


@query(
    "latencystats_rows",
    "S10",
    f"WITH {INFO} SELECT connection_id, day, metric AS command, CAST(1.5 AS DOUBLE) AS p50_us, calls + CAST(0.25 AS DOUBLE) AS p99_us, CAST(0 AS DOUBLE) AS p999_us FROM i",
)
def _latencystats(t: Tables):
    return dumps.latencystats_rows(dumps.info_rows(info_dumps(t)))


@query(
    "instance_health",
    "A36",
    f"""WITH {INFO} SELECT concat(connection_id, '/', day) AS connection_id, CAST(u AS DOUBLE)/CAST(u+c AS DOUBLE) AS hit_rate, CAST(1.25 AS DOUBLE) AS fragmentation, CAST(c AS DOUBLE) AS clients,
    'slave' AS role, CAST(c % 7 AS DOUBLE) AS replication_lag_s, c+5 AS keyspace_keys FROM d""",
)
def _health(t: Tables):
    info = dumps.info_rows(info_dumps(t))
    return topology.instance_health(info.withColumn("connection_id", F.concat_ws("/", "connection_id", F.col("day").cast("string"))))


@query(
    "keysizes_rows",
    "S12",
    """SELECT connection_id, 'db0' AS db, concat(key_type, 's') AS type, 'sizes' AS metric, CAST(b AS VARCHAR) AS bucket, count(*) AS n FROM (SELECT connection_id, key_type, CAST(pow(2, floor(log2(cardinality+1))) AS BIGINT) AS b FROM v_key) GROUP BY ALL""",
)
def _keysizes(t: Tables):
    bucket = F.pow(F.lit(2.0), F.floor(F.log2(F.col("cardinality") + 1.0))).cast("bigint")
    counts = t.key.groupBy("connection_id", "key_type", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    lines = counts.groupBy("connection_id", "key_type").agg(
        F.concat_ws(",", F.collect_list(F.format_string("%d=%d", "b", "n"))).alias("pairs")
    )
    text = lines.groupBy("connection_id").agg(
        F.concat_ws("\r\n", F.lit("# Keysizes"), F.collect_list(F.concat(F.lit("db0_distrib_"), "key_type", F.lit("s_sizes:"), "pairs"))).alias("text")
    )
    return dumps.keysizes_rows(text)


@query(
    "client_list_rows",
    "S8 S11",
    "SELECT connection_id, captured_ms, CAST(id AS VARCHAR) AS client_id, addr, name, user_name, cmd, idle, age, qbuf, CAST(0 AS BIGINT) AS obl, omem FROM v_client",
)
def _client_list(t: Tables):
    line = F.format_string(
        "id=%d addr=%s name=%s age=%d idle=%d flags=N db=0 qbuf=%d omem=%d obl=x cmd=%s user=%s lib-name=a=b",
        "id", "addr", "name", "age", "idle", "qbuf", "omem", "cmd", "user_name",
    )
    text = t.client.groupBy("connection_id", "captured_ms").agg(F.concat_ws("\n", F.collect_list(line)).alias("text"))
    return dumps.client_list_rows(text).select(
        "connection_id", "captured_ms", "client_id", "addr", "name", "user_name", "cmd", "idle", "age", "qbuf", "obl", "omem"
    )


@query(
    "cluster_nodes_rows",
    "S11",
    """SELECT node_id, address, CASE WHEN node_no % 3 = 0 THEN '' ELSE concat('h', node_no) END AS hostname, concat(role, CASE WHEN failed THEN ',fail' ELSE '' END) AS flags, CASE WHEN role='replica' THEN master_id ELSE '-' END AS master_id, config_epoch,
    'connected' AS link_state, concat(slot_start, '-', slot_end, ';', 16383 - slot_start, '-', 16383 - slot_start) AS ranges, CAST(slot_start AS VARCHAR) AS migrating, CAST(slot_end AS VARCHAR) AS importing FROM v_node""",
)
def _cluster_nodes(t: Tables):
    line = F.concat_ws(
        " ",
        "node_id",
        F.concat("address", F.when(F.col("node_no") % 3 != 0, F.concat(F.lit(",h"), F.col("node_no").cast("string"))).otherwise("")),
        F.concat("role", F.when(F.col("failed"), ",fail").otherwise("")),
        F.when(F.col("role") == "replica", F.col("master_id")).otherwise("-"),
        F.lit("0"), F.lit("1"), F.col("config_epoch").cast("string"), F.lit("connected"),
        F.format_string("%d-%d", "slot_start", "slot_end"),
        (F.lit(16383) - F.col("slot_start")).cast("string"),
        F.format_string("[%d->-abc123]", "slot_start"),
        F.format_string("[%d-<-abc123]", "slot_end"),
    )
    text = t.node.groupBy((F.col("node_no") % 5).alias("g")).agg(F.concat_ws("\n", F.collect_list(line)).alias("text"))
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ";")
    text_of = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return dumps.cluster_nodes_rows(text).select(
        "node_id", "address", "hostname", F.array_join("flags", ",").alias("flags"), "master_id", "config_epoch", "link_state",
        ranges.alias("ranges"), text_of("migrating").alias("migrating"), text_of("importing").alias("importing"),
    )


@query(
    "cluster_shards_rows",
    "S11",
    """SELECT node_id, role, concat('10.0.0.', node_no) AS endpoint, CASE WHEN node_no % 2 = 0 THEN concat('h', node_no) END AS hostname, CAST(6379 AS BIGINT) AS port, gauge AS replication_offset,
    concat((node_no//4*4*160) % 16384, '-', least((node_no//4*4*160) % 16384 + 170, 16383)) AS ranges FROM v_node""",
)
def _cluster_shards(t: Tables):
    member = F.to_json(
        F.struct(
            F.col("node_id").alias("id"),
            "role",
            F.when(F.col("node_no") % 3 == 0, F.concat(F.lit("10.0.0."), F.col("node_no").cast("string"))).alias("endpoint"),
            F.concat(F.lit("10.0.0."), F.col("node_no").cast("string")).alias("ip"),
            F.when(F.col("node_no") % 2 == 0, F.concat(F.lit("h"), F.col("node_no").cast("string"))).alias("hostname"),
            F.lit(6379).alias("port"),
            F.col("gauge").alias("replication-offset"),
        )
    )
    shard_no = F.floor(F.col("node_no") / 4)
    start = (shard_no * 640) % 16384
    shards = t.node.groupBy(shard_no.alias("s"), start.alias("a"), F.least(start + 170, F.lit(16383)).alias("b")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(member)), F.lit("]")).alias("nodes")
    )
    text = shards.groupBy((F.col("s") % 3).alias("g")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(F.format_string('{"slots":[%d,%d],"nodes":%s}', "a", "b", "nodes"))), F.lit("]")).alias("text")
    )
    return dumps.cluster_shards_rows(text).select(
        "node_id", "role", "endpoint", "hostname", "port", "replication_offset",
        F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ";").alias("ranges"),
    )


@query(
    "slot_stats_rows",
    "S11",
    "SELECT connection_id, order_key % 16384 AS slot, count(*) AS key_count, count(*) FILTER (ttl_s >= 0) AS expires_count, CAST(0 AS BIGINT) AS total_reads, CAST(0 AS BIGINT) AS total_writes FROM v_key GROUP BY 1,2",
)
def _slot_stats(t: Tables):
    per = t.key.groupBy("connection_id", (F.col("order_key") % 16384).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ttl_s") >= 0).alias("e")
    )
    entry = F.explode(
        F.array(F.format_string('[%d,["key-count",%d]]', "slot", "n"), F.format_string('[%d,["expires-count",%d]]', "slot", "e"))
    )
    text = per.select("connection_id", entry.alias("x")).groupBy("connection_id").agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list("x")), F.lit("]")).alias("text")
    )
    return dumps.slot_stats_rows(text)


def acl_dumps(t: Tables):
    entry = F.to_json(
        F.array(
            F.lit("count"), (F.col("id") % 9 + 1).cast("string"), F.lit("reason"), F.lit("auth"), F.lit("context"), F.lit("toplevel"),
            F.lit("object"), F.col("cmd"), F.lit("username"), F.col("user_name"), F.lit("age-seconds"), F.lit("1.5"),
            F.lit("client-info"), F.concat(F.lit("id=1 addr="), "addr", F.lit(" name=x")), F.lit("timestamp-created"), F.col("captured_ms").cast("string"),
            F.lit("timestamp-last-updated"), (F.col("captured_ms") + F.col("id")).cast("string"),
        )
    )
    return t.client.groupBy("connection_id", F.floor(F.col("captured_ms") / DAY).alias("day")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(entry)), F.lit("]")).alias("text")
    )


@query(
    "acl_log_rows",
    "S11 P8",
    """SELECT connection_id, id % 9 + 1 AS count, 'auth' AS reason, cmd AS object, user_name AS username, captured_ms AS created_ms, captured_ms + id AS updated_ms, string_split(addr, ':')[1] AS ip FROM v_client""",
)
def _acl_log(t: Tables):
    return dumps.acl_log_rows(acl_dumps(t)).select(
        "connection_id", "count", "reason", "object", "username", "created_ms", "updated_ms", identity.audit_ip(F.col("client_info")).alias("ip")
    )


@query(
    "upserted_acl_entries",
    "S15",
    """SELECT connection_id, username, object, arg_max(count, (updated_ms, count)) AS count, max(updated_ms) AS updated_ms FROM
    (SELECT connection_id, id % 9 + 1 AS count, cmd AS object, user_name AS username, captured_ms + id AS updated_ms FROM v_client) GROUP BY 1,2,3""",
)
def _acl_upsert(t: Tables):
    rows = dumps.acl_log_rows(acl_dumps(t)).select("connection_id", "username", "object", "count", "updated_ms")
    split = F.col("updated_ms") < ORIGIN_MS + 15 * DAY
    return sinks.upsert(rows.where(split), rows.where(~split), ["connection_id", "username", "object"], ["updated_ms", "count"])


@query(
    "first_index_snapshots",
    "S15",
    "SELECT connection_id, metric, min(ts_ms) AS ts_ms, arg_min(id, (ts_ms, id)) AS id FROM v_metric GROUP BY 1,2",
)
def _first_wins(t: Tables):
    rows = t.metric.select("connection_id", "metric", "ts_ms", "id")
    return sinks.keep_first(rows, ["connection_id", "metric"], ["ts_ms", "id"])


@query(
    "merged_events",
    "S15 A9",
    "SELECT id, CASE WHEN ts_ms < 1705363200000 THEN 'stored' ELSE 'live' END AS origin, cents FROM v_metric",
)
def _merged(t: Tables):
    base = t.metric.select("id", "ts_ms", "cents")
    stored = base.where(F.col("ts_ms") < ORIGIN_MS + 15 * DAY).select("id", F.lit("stored").alias("origin"), "cents")
    live = base.where(F.col("ts_ms") >= ORIGIN_MS + 10 * DAY).select("id", F.lit("live").alias("origin"), "cents")
    return sinks.merge_stored_and_live(stored, live)


@query(
    "retained_traces",
    "S16",
    "SELECT trace_id, span_id, start_ms FROM v_span WHERE trace_id NOT IN (SELECT trace_id FROM v_span GROUP BY 1 HAVING min(start_ms) < 1705276800000)",
)
def _retained(t: Tables):
    return sinks.retain_traces(t.span, ORIGIN_MS + 14 * DAY).select("trace_id", "span_id", "start_ms")


@query("retained_log", "S16", "SELECT connection_id, count(*) AS n FROM v_log WHERE ts_ms >= 1705276800000 GROUP BY 1")
def _retained_log(t: Tables):
    return sinks.retain(t.log, ORIGIN_MS + 14 * DAY).groupBy("connection_id").agg(F.count(F.lit(1)).alias("n"))


def scored_pairs(t: Tables):
    """Neighbouring benchmark items as sentence pairs with a 0-5 score."""
    items = t.table("benchmark")
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("sentence2"))
    return items.join(nxt, "item_id").select(
        "item_id", F.col("text").alias("sentence1"), "sentence2", ((F.col("item_id") * 7 % 51) / 10).alias("score"), (F.col("item_id") % 2).alias("label")
    )


@query(
    "load_scored_pairs",
    "S13",
    "SELECT a.item_id, a.text AS prompt_a, b.text AS prompt_b, (a.item_id*7 % 51)/10/5 >= 0.6 AS is_match FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1",
)
def _scored(t: Tables):
    return pairs.from_scores(scored_pairs(t), keep=["item_id"])


@query(
    "load_labelled_pairs",
    "S13",
    "SELECT a.item_id, a.text AS prompt_a, b.text AS prompt_b, a.item_id % 2 = 1 AS is_match FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1",
)
def _labelled(t: Tables):
    return pairs.from_labels(scored_pairs(t), keep=["item_id"])


@query(
    "class_pairs_positive",
    "S14",
    "SELECT * FROM (SELECT label, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS a, vec_id AS b FROM v_vec) WHERE a IS NOT NULL",
)
def _class_pairs(t: Tables):
    return pairs.positive_class_pairs(t.vec, "label", "vec_id")


@query(
    "class_pairs_ring",
    "S14",
    """WITH p AS (SELECT label, vec_id AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM v_vec),
      r AS (SELECT p.label, p.x, q.x AS y FROM p, range(1, 5) t(d) JOIN p q ON q.label = p.label AND q.i = (p.i + d) % p.n WHERE d < p.n)
    SELECT DISTINCT label, least(x, y) AS a, greatest(x, y) AS b FROM r""",
)
def _class_ring(t: Tables):
    return pairs.class_pairs(t.vec, "label", "vec_id", 4)


@query(
    "class_pairs_negative",
    "S14",
    """WITH h AS (SELECT vec_id, label, CAST(concat('0x', substr(md5(concat(vec_id, '#11')), 1, 15)) AS BIGINT) AS h FROM v_vec), l AS (SELECT *, lag(vec_id) OVER (ORDER BY h, vec_id) AS a, lag(label) OVER (ORDER BY h, vec_id) AS pl FROM h)
    SELECT a, vec_id AS b FROM l WHERE pl <> label ORDER BY h, vec_id LIMIT (SELECT count(*) - count(DISTINCT label) FROM v_vec)""",
)
def _class_negatives(t: Tables):
    return pairs.negative_class_pairs(t.vec, "label", "vec_id")


@query(
    "usage_costs",
    "P10",
    """SELECT conv_id, turn, model, CASE WHEN model <> 'm2' THEN CAST(floor((tin*CASE WHEN model='m0' THEN CAST(0.003 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END + tout*CASE WHEN model='m0' THEN CAST(0.006 AS DOUBLE) ELSE CAST(0.03 AS DOUBLE) END)/CAST(1000 AS DOUBLE)*CAST(1e6 AS DOUBLE)+0.5) AS BIGINT) END AS cost_micros
    FROM (SELECT conv_id, turn, concat('m', conv_id % 3) AS model, length(text) AS tin, turn*10 AS tout FROM conversations)""",
)
def _costs(t: Tables):
    usage = t.table("conversations").select(
        "conv_id", "turn", F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), F.length("text").alias("tokens_in"), (F.col("turn") * 10).alias("tokens_out")
    )
    prices = usage.select("model").distinct().where(F.col("model") != "m2").select(
        "model",
        F.when(F.col("model") == "m0", 0.003).otherwise(0.01).alias("price_in"),
        F.when(F.col("model") == "m0", 0.006).otherwise(0.03).alias("price_out"),
    )
    return scoring.with_cost_micros(usage, prices).select("conv_id", "turn", "model", "cost_micros")


@query(
    "duplicate_requests",
    "P11",
    """WITH k AS (SELECT sha256(concat('{"messages":[{"content":"', m, '","role":"', role, '"}],"model":"m1","temperature":1,"top_p":', CASE WHEN turn % 2 = 0 THEN '1' ELSE '0.5' END, '}')) AS cache_key, conv_id, turn
      FROM (SELECT conv_id, turn, role, md5(lower(text)) AS m FROM conversations))
    SELECT cache_key, count(*) AS requests, min(conv_id) AS first_conv FROM k GROUP BY 1""",
)
def _requests(t: Tables):
    message = F.struct(F.md5(F.lower("text")).alias("content"), F.col("role"))
    key = scoring.request_cache_key(
        F.lit("m1"), F.array(message), top_p=F.when(F.col("turn") % 2 == 1, F.lit(0.5))
    )
    return t.table("conversations").groupBy(key.alias("cache_key")).agg(
        F.count(F.lit(1)).alias("requests"), F.min("conv_id").alias("first_conv")
    )


@query(
    "memory_recency",
    "P13",
    """SELECT item_id, round(exp(-ln(2)*((1736000000000 - greatest(created_ms, accessed_ms))/1000)/604800), 9) AS recency,
    round(0.6*0.5 + 0.25*exp(-ln(2)*((1736000000000 - greatest(created_ms, accessed_ms))/1000)/604800) + 0.15*importance, 9) AS score FROM v_mem""",
)
def _recency(t: Tables):
    age = (F.lit(1_736_000_000_000) - F.greatest("created_ms", "accessed_ms")) / 1000
    return t.mem.select(
        "item_id",
        F.round(scoring.recency_decay(age, 604_800.0), 9).alias("recency"),
        F.round(scoring.composite_score(F.lit(0.5), age, F.col("importance"), 604_800.0), 9).alias("score"),
    )


_TOK = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({c}), '\s+'), lambda w: regexp_replace(w, '^[.,!?;:\"''()\[\]{{}}<>]+|[.,!?;:\"''()\[\]{{}}<>]+$', '', 'g')), lambda w: w <> ''))"
_TOKA = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({c}), '\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> ''))"


@query(
    "token_overlap",
    "P14",
    f"""WITH c AS (SELECT conv_id, turn, {_TOK.format(c='text')} AS a, {_TOKA.format(c='text')} AS b FROM conversations),
      n AS (SELECT x.conv_id, x.turn, x.a AS qa, y.a AS ca, x.b AS qb, y.b AS cb FROM c x JOIN c y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)
    SELECT conv_id, turn, len(qa) AS tokens, CASE WHEN len(qa) > 0 THEN len(list_intersect(qa, ca))/len(qa) ELSE 0 END AS overlap,
      CASE WHEN least(len(qb), len(cb)) > 0 THEN len(list_intersect(qb, cb))/least(len(qb), len(cb)) ELSE 0 END AS containment FROM n""",
)
def _overlap(t: Tables):
    c = t.table("conversations").select("conv_id", "turn", scoring.token_set(F.col("text")).alias("a"), scoring.token_set_ascii(F.col("text")).alias("b"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("na"), F.col("b").alias("nb"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size("a").cast("bigint").alias("tokens"), scoring.overlap(F.col("a"), F.col("na")).alias("overlap"), scoring.containment(F.col("b"), F.col("nb")).alias("containment")
    )


@query(
    "instance_gates",
    "P16 P18 P19 P20 P21",
    """SELECT id, CASE WHEN cents/50000 >= 0.85 THEN 'memory_above_threshold' WHEN id % 50 = 0 THEN 'recent_oom' WHEN metric = 'error' AND id % 3 = 0 THEN 'failover_in_progress' WHEN cents*1000 >= 10485760 THEN 'replication_lag_elevated' END AS skip_reason,
      CASE WHEN id % 4 = 0 THEN 0 WHEN id % 4 = 1 THEN CASE WHEN cents/50000 <= 1 THEN cents/50000*100 ELSE cents/50000 END WHEN cents/100 <= 1 THEN cents/100*100 ELSE cents/100 END AS percent_indexed, cents/40000*100 AS used_pct, CAST(floor(cents*(60000/1000)+0.5) AS BIGINT)*120 AS capture_bytes, CAST(7 + id % 2 AS INTEGER) AS major,
      CASE WHEN id % 5 = 0 THEN 'unverified' WHEN id % 5 = 1 THEN 'hazard' END AS acl_hazard,
      CASE WHEN id % 6 < 2 THEN CASE WHEN id % 12 < 1 OR id % 12 = 7 THEN 'hazard' ELSE 'advisory' END WHEN id % 6 < 4 AND id % 4 >= 2 THEN 'hazard' END AS fsync_hazard FROM v_metric""",
)
def _gates(t: Tables):
    i, c = F.col("id"), F.col("cents")
    reply = F.when(
        i % 5 != 0,
        F.struct(
            F.lit(False).alias("denied"),
            F.when(i % 5 < 3, F.array(F.lit("off"))).otherwise(F.array(F.lit("on"))).alias("flags"),
            F.when(i % 5 == 2, "+@all").otherwise("+@all -exec").alias("commands"),
            F.lit("~*").alias("keys"),
            F.lit("&*").alias("channels"),
        ),
    )
    indexed = F.when(i % 4 == 0, "n/a").when(i % 4 == 1, (c / 50000).cast("string")).otherwise((c / 100).cast("string"))
    return t.metric.select(
        "id",
        fleet.health_gate(c / 50000, F.when(i % 50 == 0, 1).otherwise(0), (F.col("metric") == "error") & (i % 3 == 0), c * 1000).alias("skip_reason"),
        fleet.percent_indexed(indexed).alias("percent_indexed"),
        fleet.used_percent(c, F.lit(40_000)).alias("used_pct"),
        fleet.capture_size_estimate(c, F.lit(60_000)).alias("capture_bytes"),
        keys.major_version(F.concat((i % 2 + 7).cast("string"), F.lit(".2.1"))).alias("major"),
        fleet.acl_aof_hazard(F.lit("yes"), F.lit(False), reply).alias("acl_hazard"),
        fleet.appendfsync_hazard(
            F.lit("yes"),
            F.when(i % 6 < 2, "always").when(i % 6 < 4, "everysec").otherwise("no"),
            F.lit(3),
            i % 4,
            F.when(i % 12 == 0, "err").otherwise("ok"),
            F.when(i % 12 == 7, F.array(F.lit("aof-write"))).otherwise(F.array().cast("array<string>")),
        ).alias("fsync_hazard"),
    )
