"""Client-snapshot queries."""

from fleetscope.catalog.registry import query
from fleetscope.catalog.views import Tables
from fleetscope.operators import clients

IDENT = "coalesce(nullif(name, ''), addr)"

for _by, _expr in (
    ("name", "coalesce(nullif(name, ''), '(unnamed)')"),
    ("user", "coalesce(nullif(user_name, ''), '(default)')"),
    ("addr", "addr"),
):

    @query(
        f"command_distribution_by_{_by}",
        "A1 P8",
        f"""WITH g AS (SELECT {_expr} AS identifier, cmd, count(*) AS n FROM v_client GROUP BY 1,2),
        h AS (SELECT identifier, CAST(sum(n) AS BIGINT) AS snapshots, CAST(sum(n) AS BIGINT) AS total_commands,
          arg_min(cmd, (-n, cmd)) AS top_command FROM g GROUP BY 1)
        SELECT g.identifier, cmd, n, snapshots, total_commands, top_command,
          snapshots/CAST((SELECT count(*) FROM v_client) AS BIGINT)*100 AS activity_pct FROM g JOIN h USING (identifier)""",
    )
    def _distribution(t: Tables, by=_by):
        return clients.command_distribution(t.client, by)


@query(
    "idle_connections",
    "A2 P9",
    f"""SELECT *, CASE WHEN avg_idle > 3600 AND occurrences > 100 THEN 'zombie' WHEN avg_idle > 300 AND occurrences > 50 THEN 'stale'
    ELSE 'watch' END AS advice FROM (SELECT {IDENT} AS identifier, avg(idle) AS avg_idle, max(idle) AS max_idle, count(*) AS occurrences,
    min(captured_ms) AS first_seen, max(captured_ms) AS last_seen FROM v_client WHERE idle >= 300 GROUP BY 1) WHERE occurrences >= 10""",
)
def _idle(t: Tables):
    return clients.idle_connections(t.client)


@query(
    "buffer_anomalies",
    "A3 P9",
    f"""SELECT id, {IDENT} AS identifier, addr, captured_ms, qbuf, omem, cmd AS last_command,
    CASE WHEN omem > 100000000 OR qbuf > 10000000 THEN 'critical' ELSE 'warning' END AS severity,
    CASE WHEN omem > 100000000 THEN 'huge-output' WHEN qbuf > 10000000 THEN 'oversized-input'
    WHEN omem > 10000000 THEN 'large-output' ELSE 'elevated' END AS advice FROM v_client WHERE qbuf > 1000000 OR omem > 10000000""",
)
def _buffers(t: Tables):
    return clients.buffer_anomalies(t.client)


_P95 = "(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS rn FROM v_client) WHERE rn = (SELECT CAST(floor(count(*)*CAST(0.95 AS DOUBLE)) AS BIGINT)+1 FROM v_client))"


@query(
    "buffer_stats",
    "A3",
    " UNION ALL ".join(
        f"SELECT '{c}' AS buffer, avg({c}) AS avg_size, max({c}) AS max_size, count(*) AS n, {_P95.format(c=c)} AS p95 FROM v_client"
        for c in ("qbuf", "omem")
    ),
)
def _buffer_stats(t: Tables):
    return clients.buffer_stats(t.client)


_TIMELINE = f"""SELECT captured_ms//300000*300000 AS bucket_ms, count(DISTINCT {IDENT}) AS unique_clients, count(*) AS connections,
  count(*) FILTER (cmd <> '') AS commands, avg(idle) AS avg_idle, max(qbuf) AS max_qbuf, max(omem) AS max_omem FROM v_client GROUP BY 1"""


@query("activity_timeline", "A4", _TIMELINE)
def _timeline(t: Tables):
    return clients.activity_timeline(t.client)


@query(
    "activity_timeline_commands",
    "A4",
    "SELECT captured_ms//300000*300000 AS bucket_ms, cmd, count(*) AS n FROM v_client GROUP BY 1,2",
)
def _timeline_commands(t: Tables):
    return clients.activity_commands(t.client)


_SPIKES = f"""b AS ({_TIMELINE}), u AS (SELECT bucket_ms, 'connections' AS metric, CAST(connections AS DOUBLE) AS value, CAST(connections AS HUGEINT) AS iv, CAST(1.5 AS DOUBLE) AS f FROM b
  UNION ALL SELECT bucket_ms, 'buffer', CAST(max_omem AS DOUBLE), CAST(max_omem AS HUGEINT), CAST(2 AS DOUBLE) FROM b),
m AS (SELECT *, count(*) OVER w AS cn, sum(iv) OVER w AS cs, sum(iv*iv) OVER w AS cq FROM u WINDOW w AS (PARTITION BY metric)),
k AS (SELECT *, CAST(cs AS DOUBLE)/cn AS baseline, sqrt(CAST(cn*cq - cs*cs AS DOUBLE))/CAST(cn AS DOUBLE) AS sd FROM m),
spikes AS (SELECT bucket_ms, metric, value, baseline, greatest(baseline + sd*CAST(2 AS DOUBLE), baseline*f) AS limit_value,
  value - baseline AS deviation FROM k WHERE value > greatest(baseline + sd*CAST(2 AS DOUBLE), baseline*f))"""


@query("client_spikes", "A5", f"WITH {_SPIKES} SELECT * FROM spikes")
def _spikes(t: Tables):
    return clients.client_spikes(t.client)


@query(
    "client_spike_contributors",
    "A5",
    f"""WITH {_SPIKES}, g AS (SELECT captured_ms//300000*300000 AS bucket_ms, {IDENT} AS identifier, count(*) AS n FROM v_client GROUP BY 1,2)
    SELECT * FROM (SELECT g.bucket_ms, row_number() OVER (PARTITION BY g.bucket_ms ORDER BY n DESC, identifier) AS rank, identifier,
      n/value*100 AS contribution FROM g JOIN spikes s ON s.bucket_ms = g.bucket_ms AND s.metric = 'connections') WHERE rank <= 10""",
)
def _contributors(t: Tables):
    return clients.spike_contributors(t.client)


@query(
    "commands_per_minute",
    "A5",
    f"SELECT CAST(sum(commands) AS BIGINT)/(count(*)*5) AS avg_commands_per_minute FROM ({_TIMELINE})",
)
def _per_minute(t: Tables):
    return clients.commands_per_minute(t.client)


@query(
    "client_time_series",
    "A6 P8",
    """WITH g AS (SELECT captured_ms//86400000*86400000 AS bucket_ms, name, user_name, addr, count(*) AS c FROM v_client GROUP BY ALL)
    SELECT bucket_ms, 'total' AS dim, '' AS label, CAST(sum(c) AS BIGINT) AS n FROM g GROUP BY 1
    UNION ALL SELECT bucket_ms, 'name', name, count(*) FROM g WHERE name <> '' GROUP BY 1,3
    UNION ALL SELECT bucket_ms, 'user', user_name, count(*) FROM g GROUP BY 1,3
    UNION ALL SELECT bucket_ms, 'ip', string_split(addr, ':')[1], count(*) FROM g GROUP BY 1,3""",
)
def _series(t: Tables):
    return clients.client_time_series(t.client, 86_400_000)


def _stats_sql(scope, name, user, group):
    by = f"captured_ms{', ' + group if group else ''}"
    return f"""SELECT '{scope}' AS scope, {name} AS name, {user} AS user_name,
      CAST(coalesce(sum(c) FILTER (captured_ms = (SELECT max(captured_ms) FROM v_client)), 0) AS BIGINT) AS current_n,
      max(c) AS peak_n, arg_min(captured_ms, (-c, captured_ms)) AS peak_ms, CAST(sum(a) AS DOUBLE)/CAST(sum(c) AS DOUBLE) AS avg_age
      FROM (SELECT {by}, count(*) AS c, sum(age) AS a FROM v_client GROUP BY ALL) {'GROUP BY ' + group if group else ''}"""


@query(
    "client_stats",
    "A7",
    " UNION ALL ".join(
        [
            _stats_sql("all", "''", "''", ""),
            _stats_sql("name", "name", "''", "name"),
            _stats_sql("user", "''", "user_name", "user_name"),
            _stats_sql("user_name", "name", "user_name", "name, user_name"),
        ]
    ),
)
def _stats(t: Tables):
    return clients.client_stats(t.client)


@query(
    "client_uniques",
    "A7",
    """SELECT count(DISTINCT name) AS unique_names, count(DISTINCT user_name) AS unique_users,
    count(DISTINCT string_split(addr, ':')[1]) AS unique_ips, min(captured_ms) AS earliest_ms, max(captured_ms) AS latest_ms FROM v_client""",
)
def _uniques(t: Tables):
    return clients.client_uniques(t.client)
