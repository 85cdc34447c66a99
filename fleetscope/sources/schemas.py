"""Schemas of the captured tables; every reader names one, nothing is inferred."""

from __future__ import annotations

COMMAND_LOG = (
    "connection_id string, id bigint, ts_ms bigint, captured_ms bigint, log_type string, verb string, key string, "
    "args array<string>, value bigint, client_name string, client_addr string"
)
CLIENT_SNAPSHOT = (
    "connection_id string, captured_ms bigint, client_id string, addr string, name string, user_name string, db int, "
    "cmd string, age bigint, idle bigint, flags string, sub bigint, psub bigint, multi bigint, qbuf bigint, "
    "qbuf_free bigint, obl bigint, oll bigint, omem bigint"
)
ACL_ENTRY = (
    "connection_id string, captured_ms bigint, entry_id string, count bigint, reason string, context string, "
    "object string, username string, client_info string, created_ms bigint, updated_ms bigint"
)
METRIC = "connection_id string, metric string, ts_ms bigint, id bigint, value double"
MEMORY_SNAPSHOT = (
    "connection_id string, ts_ms bigint, used_memory bigint, rss bigint, peak bigint, fragmentation double, "
    "maxmemory bigint, ops_per_sec bigint, cpu_sys double, cpu_user double"
)
COMMAND_STATS = (
    "connection_id string, captured_ms bigint, command string, calls bigint, usec bigint, rejected bigint, failed bigint"
)
ANOMALY = (
    "connection_id string, id string, ts_ms bigint, metric string, anomaly_type string, severity string, value double, "
    "baseline double, std_dev double, z_score double, threshold double, resolved boolean, related array<string>"
)
SPAN = (
    "trace_id string, span_id string, parent_id string, name string, scope string, service string, kind int, "
    "start_ns bigint, end_ns bigint, start_ms bigint, duration_ns bigint, status int, attributes map<string,string>"
)
INDEX_SNAPSHOT = (
    "connection_id string, index_name string, ts_ms bigint, num_docs bigint, memory_bytes bigint, "
    "percent_indexed double, indexing_failures bigint"
)
KEY_DETAIL = (
    "connection_id string, captured_ms bigint, key string, key_type string, memory_bytes bigint, cardinality bigint, "
    "freq bigint, idle_s bigint, ttl_s bigint"
)
CLUSTER_NODE = (
    "cluster string, captured_ms bigint, node_id string, address string, hostname string, flags array<string>, "
    "master_id string, config_epoch bigint, link_state string, ranges array<struct<start:bigint,end:bigint>>, "
    "migrating array<bigint>, importing array<bigint>"
)
VECTOR_ENTRY = (
    "entry_id bigint, embedding array<float>, prompt string, response string, model string, category string, "
    "cost_micros bigint, created_ms bigint"
)
MEMORY_ITEM = (
    "item_id bigint, embedding array<float>, content string, thread_id string, agent_id string, namespace string, "
    "tags array<string>, importance double, created_ms bigint, accessed_ms bigint, access_count bigint"
)
SIMILARITY_SAMPLE = "id bigint, ts_ms bigint, category string, score double, result string, cost_micros bigint"
OTLP_REQUEST = """
resourceSpans array<struct<
  resource: struct<attributes: array<struct<key:string, value:struct<stringValue:string>>>>,
  scopeSpans: array<struct<
    scope: struct<name:string>,
    spans: array<struct<
      traceId:string, spanId:string, parentSpanId:string, name:string, kind:int,
      startTimeUnixNano:string, endTimeUnixNano:string,
      status: struct<code:int, message:string>,
      attributes: array<struct<key:string, value:struct<
        stringValue:string, boolValue:boolean, doubleValue:double, intValue:string, arrayValue:string>>>>>>>>>
"""
