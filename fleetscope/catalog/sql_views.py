"""The same views as plain SQL, for the statements the results are checked against."""

_NAME = "CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('svc', user_id % 7) END"
_ADDR = "concat('10.0.', user_id % 16, '.', user_id % 250, ':', 40000 + event_id % 1000)"
_CONN = "concat('c', user_id % 4)"
#: All connections of these views.
CONNECTIONS = ("c0", "c1", "c2", "c3")

VIEWS: dict[str, str] = {
    "v_ev": "SELECT *, epoch_us(ts)//1000 AS ts_ms FROM events",
    "v_log": f"""
      SELECT *, CASE WHEN verb = 'HSCAN' THEN [verb, key, '0', 'COUNT', '10'] ELSE [verb, key] END AS args FROM (
        SELECT connection_id, id, ts_ms, log_type, verb,
               CASE WHEN verb = 'FT.SEARCH' THEN concat('idx', user_id % 3)
                    ELSE concat(event_type, ':', user_id, ':', id % 50) END AS key,
               value, client_name, client_addr
        FROM (SELECT {_CONN} AS connection_id, event_id AS id, ts_ms, user_id, event_type,
               CASE WHEN event_id % 5 = 0 THEN 'large-reply' WHEN event_id % 5 = 1 THEN 'large-request'
                    ELSE 'slow' END AS log_type,
               CASE WHEN event_id % 10 = 0 THEN 'HSCAN' WHEN event_type = 'click' THEN 'GET'
                    WHEN event_type = 'view' THEN 'HGETALL' WHEN event_type = 'purchase' THEN 'SET'
                    WHEN event_type = 'signup' THEN 'HSET' ELSE 'FT.SEARCH' END AS verb,
               CAST(floor(value*1000) AS BIGINT) AS value,
               {_NAME} AS client_name, {_ADDR} AS client_addr FROM v_ev))""",
    "v_client": f"""
      SELECT {_CONN} AS connection_id, event_id AS id, ts_ms//3600000*3600000 AS captured_ms, {_NAME} AS name,
             CASE WHEN user_id % 3 = 0 THEN 'default' ELSE concat('u', user_id % 3) END AS user_name,
             {_ADDR} AS addr, event_type AS cmd, (event_id*7) % 900 AS idle, (event_id*13) % 5000 AS age,
             CAST(floor(value*5000) AS BIGINT) AS qbuf, CAST(floor(value*50000) AS BIGINT) AS omem FROM v_ev""",
    "v_metric": f"""
      SELECT {_CONN} AS connection_id, event_type AS metric, ts_ms, event_id AS id, value,
             CAST(round(value*100) AS BIGINT) AS cents FROM v_ev""",
    "v_counter": """
      SELECT connection_id, metric, ts_ms, id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (
               PARTITION BY connection_id, metric, ts_ms//864000000 ORDER BY ts_ms, id
               ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM v_metric""",
    "v_span": f"""
      SELECT {_CONN} AS connection_id, event_id//8 AS trace_id, event_id AS span_id,
             CASE WHEN event_id % 8 <> 0 THEN event_id - event_id % 8 END AS parent_id, event_type AS scope,
             concat('svc', user_id % 7) AS service, ts_ms AS start_ms,
             CAST(floor(value*1e6) AS BIGINT) AS duration_ns,
             CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status FROM v_ev""",
    "v_sim": """
      SELECT event_id AS id, ts_ms, concat('cat', user_id % 3) AS category, value/1000 AS score,
             CASE WHEN value/1000 <= 0.3 THEN 'hit' ELSE 'miss' END AS result,
             CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value*10) AS BIGINT) END AS cost_micros FROM v_ev""",
    "v_key": """
      SELECT concat('c', l_suppkey % 4) AS connection_id,
             concat('part:', l_partkey, ':', l_orderkey, '-', l_linenumber) AS key,
             CASE WHEN l_linenumber % 3 = 0 THEN 'string' WHEN l_linenumber % 3 = 1 THEN 'hash' ELSE 'zset' END AS key_type,
             CAST(floor(l_extendedprice) AS BIGINT) AS memory_bytes, CAST(l_quantity AS BIGINT) AS cardinality,
             CASE WHEN l_linenumber % 2 = 0 THEN CAST(round(l_discount*100) AS BIGINT) END AS freq,
             (l_orderkey*17) % 100000 AS idle_s,
             CASE WHEN l_returnflag = 'R' THEN -1 ELSE (l_orderkey*31) % 900000 END AS ttl_s,
             l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line_number FROM lineitem""",
    "v_node": """
      SELECT concat('n', s_suppkey) AS node_id, s_suppkey AS node_no,
             concat('10.1.', s_suppkey % 8, '.', s_suppkey, ':6379') AS address,
             CAST(s_nationkey AS BIGINT) AS config_epoch,
             CASE WHEN s_suppkey % 4 = 3 THEN 'replica' ELSE 'master' END AS role, s_suppkey % 17 = 0 AS failed,
             concat('n', s_suppkey - s_suppkey % 4) AS master_id, (s_suppkey*160) % 16384 AS slot_start,
             least((s_suppkey*160) % 16384 + 170, 16383) AS slot_end,
             CAST(floor(s_acctbal*100) AS BIGINT) AS gauge FROM supplier""",
    "v_vec": """
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'entry' END AS side,
             concat('m', label % 3) AS model, concat('cat', label) AS category, vec_id*7 % 1000 AS cost_micros,
             CAST(label AS BIGINT) AS label FROM embeddings""",
    "v_mem": """
      SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS embedding, concat('t', label) AS thread_id,
             (vec_id*37 % 100)/CAST(100 AS DOUBLE) AS importance,
             1704067200000 + vec_id*3600000 AS created_ms,
             1704067200000 + vec_id*3600000 + (vec_id*11 % 50)*86400000 AS accessed_ms FROM embeddings""",
    "v_session": """
      SELECT conv_id AS session_id, turn, role, text, concat(role, ': ', text) AS line,
             DATE '2024-01-01' + CAST(conv_id % 365 AS INTEGER) AS day FROM conversations""",
}
