"""Command-log queries."""

from pyspark.sql import functions as F

from fleetscope.catalog.registry import query
from fleetscope.catalog.views import Tables
from fleetscope.functions import keys as K
from fleetscope.operators import logs

# SQL texts of the key functions, written against DuckDB's list functions.
STAR = """CASE WHEN regexp_full_match({x}, '[0-9]+') OR regexp_full_match({x}, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')
  OR regexp_full_match({x}, '[a-zA-Z0-9]{{20,}}') {extra} THEN '*' ELSE {x} END"""
_SEG = STAR.format(x="x", extra="OR regexp_full_match(x, '[0-9a-fA-F]{6,}')")
_ALL = STAR.format(x="key", extra="")
LOG_PATTERN = f"""CASE WHEN contains(key, ':') THEN array_to_string(list_transform(string_split(key, ':'), lambda x: {_SEG}), ':')
  WHEN contains(key, '/') THEN array_to_string(list_transform(string_split(key, '/'), lambda x: {_SEG}), '/') ELSE {_ALL} END"""
PREFIX = "CASE WHEN key <> '' AND NOT starts_with(verb, 'FT.') THEN concat(regexp_split_to_array(key, '[:/]')[1], ':') END"
CLIENT = "coalesce(nullif(client_name, ''), client_addr)"
PATTERNED = f"""p AS (SELECT *, upper(verb) AS command, {LOG_PATTERN} AS key_pattern,
  concat(upper(verb), ' ', {LOG_PATTERN}) AS pattern, {PREFIX} AS prefix, {CLIENT} AS client FROM v_log)"""


@query(
    "log_patterns",
    "A10 P1 P3 P8",
    f"""WITH {PATTERNED} SELECT pattern, command, key_pattern, count(*) AS n, CAST(sum(value) AS BIGINT) AS total_value,
    max(value) AS max_value, min(value) AS min_value, count(*)/(SELECT count(*) FROM p)*100 AS pct,
    CAST(sum(value) AS DOUBLE)/count(*) AS avg_value FROM p GROUP BY 1,2,3""",
)
def _log_patterns(t: Tables):
    return logs.log_patterns(t.log)


for _by in ("command", "prefix", "client"):

    @query(
        f"log_by_{_by}",
        "A10",
        f"""WITH {PATTERNED} SELECT {_by}, count(*) AS n, count(*)/(SELECT count(*) FROM p)*100 AS pct,
        CAST(sum(value) AS DOUBLE)/count(*) AS avg_value FROM p WHERE {_by} IS NOT NULL GROUP BY 1""",
    )
    def _breakdown(t: Tables, by=_by):
        return logs.log_breakdown(t.log, by)


@query(
    "log_pattern_clients",
    "A10",
    f"""WITH {PATTERNED}, g AS (SELECT pattern, client, count(*) AS n, sum(value) AS s, max(value) AS max_value FROM p GROUP BY 1,2),
    r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, client) AS rank,
      sum(n) OVER (PARTITION BY pattern) AS pn FROM g)
    SELECT pattern, client, n, max_value, rank, CAST(n AS DOUBLE)/CAST(pn AS BIGINT)*100 AS pct, CAST(s AS DOUBLE)/n AS avg_value
    FROM r WHERE rank <= 10""",
)
def _pattern_clients(t: Tables):
    return logs.pattern_clients(t.log)


@query(
    "log_pattern_examples",
    "A10 P4",
    f"""WITH {PATTERNED} SELECT pattern, rank, id, ts_ms, value, client_addr, array_to_string(args, ' ') AS full_command
    FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY ts_ms, id) AS rank FROM p) WHERE rank <= 3""",
)
def _pattern_examples(t: Tables):
    return logs.pattern_examples(t.log)


@query(
    "log_scan_filtered",
    "S1",
    """SELECT connection_id, id, ts_ms, verb, value FROM v_log WHERE ts_ms >= 1704412800000 AND ts_ms <= 1706400000000
    AND contains(upper(verb), 'GET') AND contains(lower(client_name), 'svc') AND log_type = 'slow' AND value >= 50000""",
)
def _log_scan(t: Tables):
    rows = logs.log_scan(
        t.log, 1_704_412_800_000, 1_706_400_000_000, command="get", client="SVC", log_type="slow", min_value=50_000
    )
    return rows.select("connection_id", "id", "ts_ms", "verb", "value")


@query(
    "log_scan_page_by_magnitude",
    "S1",
    "SELECT id, value FROM v_log WHERE log_type = 'large-reply' ORDER BY value DESC, id DESC LIMIT 50 OFFSET 25",
)
def _log_page(t: Tables):
    return logs.log_scan(t.log, log_type="large-reply", sort_by="magnitude", limit=50, offset=25).select("id", "value")


@query("top_commands", "A11", "SELECT upper(verb) AS command, count(*) AS n FROM v_log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _top_commands(t: Tables):
    return logs.top_commands(t.log)


@query("top_commands_sketch", "A11", "SELECT upper(verb) AS command, count(*) AS n FROM v_log GROUP BY 1")
def _top_commands_sketch(t: Tables):
    return logs.top_commands_sketch(t.log)


@query(
    "scan_skew",
    "A12 P7",
    """WITH s AS (SELECT *, value/10 AS per FROM v_log WHERE log_type = 'large-reply' AND verb = 'HSCAN' AND value >= 262144)
    SELECT connection_id, key AS subject, arg_min(verb, (ts_ms, id)) AS verb, count(*) AS sightings, CAST(sum(value) AS BIGINT) AS total_bytes,
    max(ts_ms) AS last_ms, CAST(floor(max(per)+0.5) AS BIGINT) AS worst_per_element FROM s WHERE per >= 4096
    GROUP BY 1,2 HAVING count(*) >= 2 OR max(per) >= 40960""",
)
def _scan_skew(t: Tables):
    return logs.scan_skew(t.log)


@query(
    "large_reply_pressure",
    "A13",
    """SELECT connection_id, upper(verb) AS command, count(*) AS crossings, max(value) AS worst_bytes, avg(value) AS avg_bytes,
    CAST(sum(value) AS BIGINT) AS total_bytes, max(ts_ms) AS last_ms FROM v_log WHERE log_type = 'large-reply' AND value >= 100000
    GROUP BY 1,2 HAVING count(*) >= 5""",
)
def _large_reply(t: Tables):
    return logs.large_reply_pressure(t.log, 100_000)


@query(
    "cluster_log_newest",
    "A42",
    "SELECT connection_id AS node, id, ts_ms, value FROM v_log ORDER BY ts_ms DESC, id DESC LIMIT 100",
)
def _cluster_log(t: Tables):
    return logs.cluster_log(t.log, "connection_id", 100).select("node", "id", "ts_ms", "value")


@query(
    "keyspace_patterns",
    "P2",
    """SELECT pattern, count(*) AS n FROM (SELECT array_to_string(list_transform(regexp_split_to_array(key, '[:._-]'), lambda x:
    CASE WHEN regexp_full_match(x, '[0-9]+') OR regexp_full_match(x, '[0-9a-fA-F]{24}') OR regexp_full_match(x, '[0-9a-fA-F]{32,}')
    THEN '*' ELSE x END), ':') AS pattern FROM v_key) GROUP BY 1""",
)
def _keyspace_patterns(t: Tables):
    return t.key.groupBy(K.keyspace_pattern(F.col("key")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sanitized_document_words",
    "P4",
    r"""SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_filter(w, lambda x: length(x) > 200 OR contains(x, chr(65533))
    OR regexp_matches(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]'))) AS BIGINT) AS masked FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def _sanitized(t: Tables):
    words = F.split("text", " ")
    safe = K.sanitize_args(words)
    return t.table("documents").select(
        "doc_id",
        F.size(words).cast("bigint").alias("words"),
        F.size(F.filter(safe, lambda a: a == K.BLOB)).cast("bigint").alias("masked"),
    )


@query(
    "command_shapes",
    "P5",
    "SELECT concat(upper(args[1]), ':', len(args)-1) AS shape, count(*) AS n FROM v_log GROUP BY 1",
)
def _shapes(t: Tables):
    return t.log.groupBy(K.command_shape(F.col("args")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_commands",
    "P7",
    """SELECT id, verb, key, CAST(10 AS BIGINT) AS requested FROM v_log WHERE verb = 'HSCAN'""",
)
def _scans(t: Tables):
    scan = K.scan_command(F.col("args"))
    return t.log.withColumn("s", scan).where(F.col("s").isNotNull()).select(
        "id", "s.verb", "s.key", F.col("s.count").alias("requested")
    )
