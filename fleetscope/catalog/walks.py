"""SQL statements for the stateful queries: one recursive walk over numbered rows per key."""

from __future__ import annotations

DAY, HOUR, ORIGIN = 86_400_000, 3_600_000, 1_704_067_200_000


def _walk(rows: str, key: str, seed: str, step: str, final: str, order: str = "ts_ms, id", more: str = "") -> str:
    """``seed`` and ``step`` list the state columns; a step sees the row as ``q`` and the state as ``r``."""
    return f"""WITH RECURSIVE {rows}, q AS MATERIALIZED (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM src),
      r AS (SELECT k, CAST(0 AS BIGINT) AS i, {seed} FROM (SELECT DISTINCT k FROM q)
        UNION ALL SELECT q.k, q.i, {step} FROM r JOIN q ON q.k = r.k AND q.i = r.i + 1){more} {final}"""


def _cooldown(rows: str, key: str, wait: int, op: str, final: str) -> str:
    """Greedy choice of rows at least ``wait`` after the last chosen one."""
    return f"""WITH RECURSIVE {rows}, q AS MATERIALIZED (SELECT *, {key} AS k FROM src),
      r AS (SELECT k, min(ts_ms) AS t FROM q GROUP BY 1 UNION ALL SELECT r.k, (SELECT min(q.ts_ms) FROM q WHERE q.k = r.k AND q.ts_ms {op} r.t + {wait}) FROM r
        WHERE EXISTS (SELECT 1 FROM q WHERE q.k = r.k AND q.ts_ms {op} r.t + {wait})) {final}"""


_W = 2 * HOUR
ADMITTED = _walk(
    "src AS (SELECT connection_id, ts_ms, id FROM v_metric)",
    "connection_id",
    "CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS adm, CAST([] AS BIGINT[]) AS live",
    f"""q.ts_ms, q.id, CASE WHEN len(list_filter(r.adm, lambda x: x > q.ts_ms - {_W})) < 5 THEN list_append(list_filter(r.adm, lambda x: x > q.ts_ms - {_W}), q.ts_ms) ELSE list_filter(r.adm, lambda x: x > q.ts_ms - {_W}) END,
    list_filter(r.adm, lambda x: x > q.ts_ms - {_W})""",
    f"""SELECT k AS rate_key, ts_ms, id, len(live) < 5 AS admitted, CAST(CASE WHEN len(live) < 5 THEN 4 - len(live) ELSE 0 END AS BIGINT) AS remaining,
    CAST(CASE WHEN len(live) < 5 THEN 0 ELSE greatest(0, live[1] + {_W} - ts_ms) END AS BIGINT) AS retry_after_ms FROM r WHERE i > 0""",
)


def spikes(baseline: str, consecutive: int, wait: int) -> str:
    quiet = f"(r.fired IS NOT NULL AND q.ts_ms - r.fired < {wait})"
    return _walk(
        f"""{baseline}, src AS (SELECT b.*, m.value, CASE WHEN stddev = 0 THEN 0 ELSE (b.cents-mean)/stddev END AS z FROM b JOIN v_metric m ON m.id = b.id WHERE ready AND CASE WHEN stddev = 0 THEN 0 ELSE (b.cents-mean)/stddev END >= 0)""",
        "concat(connection_id, '/', metric)",
        """CAST(NULL AS VARCHAR) AS connection_id, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS z, CAST(NULL AS DOUBLE) AS value, 0 AS n, CAST(NULL AS BIGINT) AS fired, false AS hit""",
        f"""q.connection_id, q.metric, q.ts_ms, q.id, q.z, q.value,
        CASE WHEN {quiet} THEN r.n WHEN abs(q.z) < 2 THEN 0 WHEN r.n + 1 >= {consecutive} THEN 0 ELSE r.n + 1 END,
        CASE WHEN {quiet} OR abs(q.z) < 2 OR r.n + 1 < {consecutive} THEN r.fired ELSE q.ts_ms END, NOT {quiet} AND abs(q.z) >= 2 AND r.n + 1 >= {consecutive}""",
        """SELECT connection_id, metric, ts_ms, id, CASE WHEN abs(z) >= 3 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS anomaly_type, value FROM r WHERE hit""",
    )


BACKFILL = _walk(
    """src AS (SELECT concat(connection_id, '/', id % 10) AS prompt, ts_ms//60 AS ts_ms, id, CASE WHEN metric IN ('click','view','error') THEN 'miss' ELSE 'store' END AS kind, cents FROM v_metric)""",
    "prompt",
    "CAST([] AS STRUCT(t BIGINT, i BIGINT)[]) AS p, CAST(NULL AS BIGINT) AS miss_id, CAST(NULL AS BIGINT) AS store_id, CAST(NULL AS BIGINT) AS cost",
    """CASE WHEN q.kind = 'miss' THEN list_append(list_filter(r.p, lambda x: x.t >= q.ts_ms - 300000), {'t': q.ts_ms, 'i': q.id}) ELSE list_slice(list_filter(r.p, lambda x: x.t >= q.ts_ms - 300000), 2, 1000000) END,
    CASE WHEN q.kind = 'store' THEN list_filter(r.p, lambda x: x.t >= q.ts_ms - 300000)[1].i END, q.id, q.cents""",
    "SELECT k AS prompt, miss_id, store_id, cost FROM r WHERE miss_id IS NOT NULL",
)

_OP = """CASE WHEN NOT q.inc THEN NULL
  WHEN q.tomb THEN CASE WHEN r.st IS NULL THEN 'unmatched_tombstone' WHEN q.day < r.dt THEN 'noop' ELSE 'delete' END
  WHEN r.st IS NULL THEN 'add' WHEN r.st = q.statement THEN CASE WHEN coalesce(q.day, '') > coalesce(r.dt, '') THEN 'update' ELSE 'noop' END
  WHEN q.day IS NULL OR q.day >= coalesce(r.dt, '') THEN 'update' ELSE 'noop' END"""
FACTS = _walk(
    f"""src AS (SELECT concat('s', user_id % 4) AS scope, concat('topic ', user_id) AS subject_key, ts_ms >= {ORIGIN + 10 * DAY} AS inc, event_id AS seq, concat(event_type, ' is ', event_id % 3) AS statement,
      CASE WHEN event_id % 5 <> 0 THEN strftime(DATE '2024-01-01' + CAST(event_id % 90 AS INTEGER), '%Y-%m-%d') END AS day, ts_ms >= {ORIGIN + 10 * DAY} AND event_type = 'error' AS tomb FROM v_ev)""",
    "concat(scope, '|', subject_key)",
    "CAST(NULL AS VARCHAR) AS scope, CAST(NULL AS VARCHAR) AS subject_key, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS st, CAST(NULL AS VARCHAR) AS dt, CAST(NULL AS VARCHAR) AS op",
    f"""q.scope, q.subject_key, q.seq, CASE WHEN NOT q.inc THEN coalesce(r.st, q.statement) WHEN {_OP} = 'delete' THEN NULL WHEN {_OP} IN ('add','update') THEN q.statement ELSE r.st END,
    CASE WHEN NOT q.inc THEN CASE WHEN r.st IS NULL THEN q.day ELSE r.dt END WHEN {_OP} = 'delete' THEN NULL WHEN {_OP} IN ('add','update') THEN q.day ELSE r.dt END, {_OP}""",
    "SELECT scope, subject_key, seq, op, CASE WHEN op IN ('add','update') THEN st END AS statement, CASE WHEN op IN ('add','update') THEN dt END AS date FROM r WHERE op IS NOT NULL",
    order="inc, seq",
)

BURSTS = _cooldown(
    """e AS (SELECT connection_id, concat(metric, '/', id % 3) AS en, id % 3 AS ip, ts_ms//60 AS ts_ms, max(CAST(floor(total/40) AS BIGINT)) AS c FROM v_counter GROUP BY 1,2,3,4),
      d AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 1200000 THEN greatest(0, c - lag(c) OVER w) ELSE 0 END AS d FROM e WINDOW w AS (PARTITION BY connection_id, en ORDER BY ts_ms)),
      g AS (SELECT connection_id, concat('10.3.0.', ip) AS client_ip, ts_ms, sum(d) AS d FROM d GROUP BY 1,2,3),
      src AS (SELECT * FROM (SELECT connection_id, client_ip, ts_ms, CAST(sum(d) OVER (PARTITION BY connection_id, client_ip ORDER BY ts_ms RANGE BETWEEN 299999 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM g) WHERE failures >= 10)""",
    "concat(connection_id, '|', client_ip)",
    900_000,
    ">",
    "SELECT connection_id, client_ip, ts_ms, failures FROM r JOIN q ON q.k = r.k AND q.ts_ms = r.t",
)

UNEXPLAINED = _cooldown(
    """s AS (SELECT connection_id, ts_ms//60 AS ts_ms, id, CASE WHEN value > 150 THEN 1 ELSE 0 END AS d, id % 7 AS rep FROM v_metric),
      o AS (SELECT *, greatest(0, d - greatest(0, rep - coalesce(lag(rep) OVER (PARTITION BY connection_id ORDER BY ts_ms, id), rep))) AS odd FROM s),
      src AS (SELECT connection_id, ts_ms, CAST(max(rc) AS BIGINT) AS recent FROM (SELECT *, sum(odd) OVER (PARTITION BY connection_id ORDER BY ts_ms RANGE BETWEEN 300000 PRECEDING AND CURRENT ROW) AS rc FROM o WHERE odd > 0) WHERE rc >= 2 GROUP BY 1,2)""",
    "connection_id",
    300_000,
    ">=",
    "SELECT connection_id, ts_ms, recent FROM r JOIN q ON q.k = r.k AND q.ts_ms = r.t",
)

PRESSURE = _cooldown(
    """b AS (SELECT connection_id, concat('10.2.0.', id % 3) AS addr, ts_ms//60 AS ts_ms, max(struct_pack(id := id, p := cents/40000 >= 0.6 OR cents >= 20000*CAST(0.6 AS DOUBLE))) AS x, bool_or(cents/40000 >= 0.6 OR cents >= 20000*CAST(0.6 AS DOUBLE)) AS pr FROM v_metric WHERE id % 5 <> 4 GROUP BY 1,2,3),
      y AS (SELECT DISTINCT connection_id, ts_ms//60 AS ts_ms FROM v_metric WHERE id % 5 = 4),
      l AS (SELECT y.connection_id, y.ts_ms, b.addr, max(b.ts_ms) AS seen, arg_max(b.pr, b.ts_ms) AS pr FROM y JOIN b ON b.connection_id = y.connection_id AND b.ts_ms <= y.ts_ms AND y.ts_ms - b.ts_ms <= 300000 GROUP BY 1,2,3),
      src AS (SELECT connection_id, ts_ms, arg_max(addr, (seen, addr)) AS addr FROM l WHERE pr AND seen < ts_ms GROUP BY 1,2)""",
    "connection_id",
    300_000,
    ">=",
    "SELECT connection_id, ts_ms, addr FROM r JOIN q ON q.k = r.k AND q.ts_ms = r.t",
)

_RUN = "CASE WHEN q.lv = 0 THEN 0 WHEN q.lv = r.last THEN r.run + 1 ELSE 1 END"
_LOW = "CASE WHEN q.lv = 0 THEN 0 ELSE least(r.acked, q.lv) END"
LOAD = _walk(
    """src AS (SELECT connection_id, ts_ms, id, busy, CASE WHEN busy >= 0.95 THEN 2 WHEN busy >= 0.8 THEN 1 ELSE 0 END AS lv FROM (SELECT connection_id, ts_ms, id, CAST(CASE WHEN (id//25) % 7 = 2 THEN 0.97 WHEN (id//25) % 7 IN (3, 5) THEN 0.85 WHEN id % 17 = 0 THEN 0.99 ELSE 0.3 END AS DOUBLE) AS busy FROM v_metric))""",
    "connection_id",
    "CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS busy, 0 AS last, 0 AS run, 0 AS acked, false AS hit",
    f"q.ts_ms, q.id, q.busy, q.lv, {_RUN}, CASE WHEN {_RUN} >= 3 AND q.lv > {_LOW} THEN q.lv ELSE {_LOW} END, {_RUN} >= 3 AND q.lv > {_LOW}",
    "SELECT k AS connection_id, ts_ms, id, busy, last AS level FROM r WHERE hit",
)

_BACK = "(r.has AND (q.el < r.el OR q.pr < r.done))"
_NEW = f"(NOT r.has OR {_BACK})"
_MOVED = "CASE WHEN q.pr > r.done THEN q.ts_ms ELSE r.moved END"
_FROZEN = f"(q.pr < 30 AND q.ts_ms - {_MOVED} >= 60000)"
_LATE = f"(q.ip AND NOT {_NEW} AND NOT r.told AND ({_FROZEN} OR q.el >= 600))"
_LONG = f"(q.ip AND NOT {_NEW} AND NOT r.told AND NOT {_LATE} AND NOT r.warned AND q.el >= 120)"
STALL = _walk(
    """src AS (SELECT connection_id, CASE WHEN id % 2 = 0 THEN 'rdb' ELSE 'aof' END AS child, ts_ms//6 AS ts_ms, id, (id//50) % 3 <> 0 AS ip, (id % 50)*20 AS el, least(id % 50, 20) AS pr, CASE WHEN (id//50) % 7 = 6 THEN 'err' ELSE 'ok' END AS st FROM v_metric)""",
    "concat(connection_id, '|', child)",
    "CAST(NULL AS VARCHAR) AS connection_id, CAST(NULL AS VARCHAR) AS child, CAST(NULL AS BIGINT) AS ts_ms, false AS err, false AS has, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS el, false AS warned, false AS told, CAST(NULL AS VARCHAR) AS e1, CAST(NULL AS VARCHAR) AS e2",
    f"""q.connection_id, q.child, q.ts_ms, q.st = 'err', q.ip, CASE WHEN {_NEW} THEN q.pr ELSE greatest(r.done, q.pr) END, CASE WHEN {_NEW} THEN q.ts_ms ELSE {_MOVED} END, q.el,
    CASE WHEN NOT q.ip OR {_NEW} THEN false ELSE r.warned OR {_LONG} END, CASE WHEN NOT q.ip OR {_NEW} THEN false ELSE r.told OR {_LATE} END, CASE WHEN q.st = 'err' AND NOT r.err THEN 'error' END,
    CASE WHEN {_LATE} THEN CASE WHEN {_FROZEN} THEN 'stall' ELSE 'exceeded' END WHEN {_LONG} THEN 'long' END""",
    "SELECT connection_id, child, ts_ms, e1 AS reason FROM r WHERE e1 IS NOT NULL UNION ALL SELECT connection_id, child, ts_ms, e2 FROM r WHERE e2 IS NOT NULL",
)

_SEEK = "(q.role = 'pre-candidate')"
_OVER = f"(q.role = 'leader' OR (r.since IS NOT NULL AND q.commit > r.cm) OR (r.since IS NOT NULL AND NOT {_SEEK} AND q.ts_ms - r.seek >= 30000) OR (NOT {_SEEK} AND r.since IS NULL))"
_OUT = f"(NOT {_OVER} AND q.ts_ms - coalesce(r.since, q.ts_ms) >= 40000 AND {_SEEK} AND NOT r.act)"
RAFT = _walk(
    """src AS (SELECT connection_id, ts_ms//60 AS ts_ms, id, CASE (id//80) % 5 WHEN 2 THEN CASE WHEN id % 3 = 0 THEN 'pre-candidate' ELSE 'follower' END WHEN 3 THEN 'leader' ELSE 'follower' END AS role, id//27 AS term, id//80 AS commit FROM v_metric)""",
    "connection_id",
    """CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS cm, CAST(NULL AS BIGINT) AS seek, false AS act, CAST(NULL AS VARCHAR) AS ev, CAST(0 AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS term, CAST([] AS BIGINT[]) AS el, CAST(0 AS BIGINT) AS churn""",
    f"""q.ts_ms, CASE WHEN {_OVER} THEN NULL ELSE coalesce(r.since, q.ts_ms) END, CASE WHEN {_OVER} THEN NULL WHEN r.since IS NULL THEN q.commit ELSE r.cm END, CASE WHEN {_OVER} THEN NULL WHEN {_SEEK} THEN q.ts_ms ELSE r.seek END,
    NOT {_OVER} AND (r.act OR {_OUT}), CASE WHEN {_OVER} AND r.act THEN 'leader_recovered' WHEN {_OUT} THEN 'no_leader' END, CASE WHEN {_OUT} THEN q.ts_ms - coalesce(r.since, q.ts_ms) ELSE 0 END, q.term,
    CASE WHEN q.term > r.term THEN CASE WHEN len(list_filter(r.el, lambda x: x >= q.ts_ms - 60000)) + 1 >= 3 THEN CAST([] AS BIGINT[]) ELSE list_append(list_filter(r.el, lambda x: x >= q.ts_ms - 60000), q.ts_ms) END ELSE r.el END,
    CASE WHEN q.term > r.term AND len(list_filter(r.el, lambda x: x >= q.ts_ms - 60000)) + 1 >= 3 THEN len(list_filter(r.el, lambda x: x >= q.ts_ms - 60000)) + 1 ELSE 0 END""",
    "SELECT k AS connection_id, ts_ms, ev AS kind, amount FROM r WHERE ev IS NOT NULL UNION ALL SELECT k, ts_ms, 'election_churn', churn FROM r WHERE churn > 0",
)

_NEWSHARD = "(r.seen IS NULL OR q.ts_ms - r.seen > 120000)"
_IGN = "(q.epoch < r.ep OR (q.epoch = r.ep AND q.owner <> r.ow AND list_contains(q.bad, r.ow)))"
_B = "list_filter(CASE WHEN q.epoch > r.ep THEN list_append(r.bumps, q.ts_ms) ELSE r.bumps END, lambda x: q.ts_ms - x <= 60000)"
_F = "list_filter(CASE WHEN q.owner <> r.ow THEN list_append(r.flips, q.ts_ms) ELSE r.flips END, lambda x: q.ts_ms - x <= 60000)"
_HIT = f"(NOT {_NEWSHARD} AND NOT {_IGN} AND NOT q.resh AND greatest(len({_B}), len({_F})) >= 3)"
CHURN = _walk(
    """c AS (SELECT connection_id, ts_ms//3600000*8000 AS ts_ms, concat('s', id % 3) AS shard, concat('n', (id//37) % 5) AS node_id, id//37 AS epoch, metric <> 'error' AS live, id % 41 = 0 AS resh FROM v_metric),
      src AS (SELECT connection_id, shard, ts_ms, -x.e AS epoch, x.n AS owner, x.r AS resh, bad FROM (SELECT connection_id, shard, ts_ms, min(struct_pack(e := -epoch, n := node_id, r := resh)) FILTER (live) AS x, coalesce(list(DISTINCT node_id) FILTER (NOT live), []) AS bad FROM c GROUP BY 1,2,3) WHERE x IS NOT NULL)""",
    "concat(connection_id, '|', shard)",
    """CAST(NULL AS VARCHAR) AS connection_id, CAST(NULL AS VARCHAR) AS shard, CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS ep, CAST(NULL AS VARCHAR) AS ow, CAST([] AS BIGINT[]) AS bumps, CAST([] AS BIGINT[]) AS flips, CAST(NULL AS BIGINT) AS fired, CAST(0 AS BIGINT) AS changes, false AS again""",
    f"""q.connection_id, q.shard, q.ts_ms, q.ts_ms, CASE WHEN {_NEWSHARD} OR NOT {_IGN} THEN q.epoch ELSE r.ep END, CASE WHEN {_NEWSHARD} OR NOT {_IGN} THEN q.owner ELSE r.ow END,
    CASE WHEN {_NEWSHARD} OR {_HIT} THEN CAST([] AS BIGINT[]) WHEN {_IGN} OR q.resh THEN r.bumps ELSE {_B} END, CASE WHEN {_NEWSHARD} OR {_HIT} THEN CAST([] AS BIGINT[]) WHEN {_IGN} OR q.resh THEN r.flips ELSE {_F} END,
    CASE WHEN {_NEWSHARD} THEN NULL WHEN {_HIT} THEN q.ts_ms ELSE r.fired END, CASE WHEN {_HIT} THEN greatest(len({_B}), len({_F})) ELSE 0 END, coalesce({_HIT} AND q.ts_ms - r.fired <= 120000, false)""",
    "SELECT connection_id, shard, ts_ms, changes, CASE WHEN again THEN 'critical' ELSE 'warning' END AS severity FROM r WHERE changes > 0",
    order="ts_ms",
)

_GONE = "(r.lf IS NOT NULL OR (r.poll IS NOT NULL AND q.poll - r.poll > 1))"
_LEFT = "coalesce(r.lf, q.left_ms)"
_ABS = "(CASE WHEN r.lf IS NULL THEN 0 ELSE r.ab END + q.poll - r.poll - 1)"
_DROP = f"(q.resets > CASE WHEN r.lf IS NULL THEN r.sr ELSE r.rs END OR q.prior_ms - {_LEFT} > 21600000)"
REJOIN = _walk(
    """s AS (SELECT connection_id, captured_ms AS ts_ms, concat(user_name, '/', name) AS node_id, bool_or(idle < 700) AS live FROM v_client GROUP BY 1,2,3),
      p AS (SELECT connection_id, ts_ms, count(*) AS n FROM s GROUP BY 1,2), o AS (SELECT *, row_number() OVER w - 1 AS poll, lag(ts_ms) OVER w AS prior_ms, lag(n) OVER w AS pn FROM p WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms)),
      u AS (SELECT *, CASE WHEN n <= 1 AND pn - n >= 2 THEN 1 ELSE 0 END AS rst FROM o), v AS (SELECT *, sum(rst) OVER (PARTITION BY connection_id ORDER BY ts_ms) AS rw FROM u),
      j AS (SELECT s.*, v.poll, v.prior_ms, rw - rst AS resets, rw AS resets_with, lag(v.poll) OVER (PARTITION BY s.connection_id, node_id ORDER BY s.ts_ms) AS lp FROM s JOIN v ON v.connection_id = s.connection_id AND v.ts_ms = s.ts_ms),
      src AS (SELECT j.*, v2.ts_ms AS left_ms FROM j LEFT JOIN v v2 ON v2.connection_id = j.connection_id AND v2.poll = j.lp + 1)""",
    "concat(connection_id, '|', node_id)",
    """CAST(NULL AS VARCHAR) AS connection_id, CAST(NULL AS VARCHAR) AS node_id, CAST(NULL AS BIGINT) AS poll, CAST(NULL AS BIGINT) AS lf, CAST(0 AS BIGINT) AS ab, CAST(0 AS HUGEINT) AS rs, CAST(0 AS HUGEINT) AS sr, CAST(NULL AS BIGINT) AS d, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS a""",
    f"""q.connection_id, q.node_id, q.poll, CASE WHEN {_GONE} AND NOT {_DROP} AND NOT q.live THEN {_LEFT} END, CASE WHEN {_GONE} THEN {_ABS} ELSE 0 END, CASE WHEN r.lf IS NULL THEN r.sr ELSE r.rs END, q.resets_with,
    CASE WHEN {_GONE} AND NOT {_DROP} AND q.live AND {_ABS} >= 2 AND q.ts_ms - {_LEFT} >= 60000 THEN {_LEFT} END, q.ts_ms, {_ABS}""",
    "SELECT connection_id, node_id, d AS departed_ms, t AS returned_ms, a AS absent_polls FROM r WHERE d IS NOT NULL",
    order="ts_ms",
)

SAMPLES = f"""smp AS (SELECT connection_id, metric AS command, (ts_ms//3600000 - {ORIGIN // HOUR})*60000 AS ts_ms, CAST(max(cents) AS DOUBLE) AS p99_us, CAST(count(*)*60 AS DOUBLE) AS cpm, CASE WHEN ts_ms//3600000 - {ORIGIN // HOUR} > 400 THEN 9 ELSE 8 END AS major FROM v_metric GROUP BY 1,2,3,6),
  el AS (SELECT *, cpm >= 60 AND row_number() OVER (PARTITION BY connection_id, ts_ms ORDER BY cpm DESC, command) <= 20 AS eligible FROM smp),
  po AS (SELECT DISTINCT connection_id, ts_ms, major FROM smp), pv AS (SELECT *, lag(major) OVER (PARTITION BY connection_id ORDER BY ts_ms) AS fm FROM po),
  win AS (SELECT connection_id, fm, major AS tm, ts_ms AS op, ts_ms + {DAY} AS cl FROM pv WHERE major > fm)"""
UPGRADE = f"""WITH {SAMPLES}, ba AS (SELECT s.connection_id, op, command, quantile_cont(p99_us, 0.5) AS base FROM smp s JOIN win w ON w.connection_id = s.connection_id AND s.major = fm AND s.ts_ms BETWEEN op - 21600000 AND op GROUP BY 1,2,3 HAVING count(*) >= 5),
  af AS (SELECT e.*, w.op, base, eligible AND e.major >= tm AND p99_us >= base*CAST(1.05 AS DOUBLE) AND p99_us - base >= 1000 AS bad FROM el e JOIN win w ON w.connection_id = e.connection_id AND e.ts_ms BETWEEN op AND cl JOIN ba ON ba.connection_id = e.connection_id AND ba.op = w.op AND ba.command = e.command),
  st AS (SELECT *, bad AND lag(bad) OVER (PARTITION BY connection_id, op, command ORDER BY ts_ms) AS ripe FROM af), fi AS (SELECT connection_id, op, min(ts_ms) AS t FROM st WHERE ripe GROUP BY 1,2)
  SELECT st.connection_id, st.op AS opened_ms, st.ts_ms, command, base AS baseline_us, p99_us, CASE WHEN p99_us >= base*3 OR p99_us >= 100000 THEN 'critical' ELSE 'warning' END AS severity FROM st JOIN fi ON fi.connection_id = st.connection_id AND fi.op = st.op AND fi.t = st.ts_ms WHERE ripe"""
SUSTAINED = _walk(
    f"""{SAMPLES}, bs AS (SELECT *, quantile_cont(p99_us, 0.5) OVER w AS base, count(*) OVER w AS bn FROM el WINDOW w AS (PARTITION BY connection_id, command ORDER BY ts_ms RANGE BETWEEN {DAY} PRECEDING AND 300000 PRECEDING)),
      src AS (SELECT bs.*, coalesce(bn >= 30 AND p99_us >= base*CAST(1.2 AS DOUBLE) AND p99_us - base >= 1000 AND NOT EXISTS (SELECT 1 FROM win WHERE win.connection_id = bs.connection_id AND bs.ts_ms BETWEEN op AND cl), false) AS bad FROM bs WHERE eligible)""",
    "concat(connection_id, '|', command)",
    "CAST(NULL AS VARCHAR) AS connection_id, CAST(NULL AS VARCHAR) AS command, CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS DOUBLE) AS p99_us, CAST(NULL AS DOUBLE) AS baseline_us, 0 AS n, CAST(NULL AS BIGINT) AS fired, false AS hit",
    """q.connection_id, q.command, q.ts_ms, q.p99_us, q.base, CASE WHEN NOT q.bad THEN 0 WHEN r.n + 1 >= 2 AND (r.fired IS NULL OR q.ts_ms - r.fired >= 1800000) THEN 0 ELSE r.n + 1 END,
    CASE WHEN q.bad AND r.n + 1 >= 2 AND (r.fired IS NULL OR q.ts_ms - r.fired >= 1800000) THEN q.ts_ms ELSE r.fired END, q.bad AND r.n + 1 >= 2 AND (r.fired IS NULL OR q.ts_ms - r.fired >= 1800000)""",
    "SELECT connection_id, command, ts_ms, p99_us, baseline_us FROM r WHERE hit",
    order="ts_ms",
)

CHUNKS = _walk(
    r"""w AS (SELECT session_id, turn, line, regexp_split_to_array(trim(line, E' \t\n\r'), '\s+') AS w FROM v_session),
      src AS (SELECT session_id, turn, g.range AS piece, CASE WHEN len(w) <= 40 THEN line ELSE array_to_string(list_slice(w, CAST(g.range AS BIGINT)*40+1, CAST(g.range AS BIGINT)*40+40), ' ') END AS text,
        CASE WHEN len(w) <= 40 THEN len(w) ELSE least(40, len(w) - g.range*40) END AS size FROM w, range(1000) g WHERE g.range = 0 OR (len(w) > 40 AND g.range*40 < len(w)))""",
    "session_id",
    "CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS part, CAST(NULL AS VARCHAR) AS text",
    "CASE WHEN r.used > 0 AND r.used + q.size <= 40 THEN r.used + q.size ELSE q.size END, CASE WHEN r.used > 0 AND r.used + q.size <= 40 THEN r.part ELSE r.part + 1 END, q.text",
    "SELECT k AS session_id, part, string_agg(text, chr(10) ORDER BY i) AS text FROM r WHERE i > 0 GROUP BY 1,2",
    order="turn, piece",
)

_FRESH = "len(list_filter(q.{c}, lambda x: r.fl IS NULL OR x > r.fl))"
_D, _E = _FRESH.format(c="drops"), _FRESH.format(c="events")
_OPEN = "(NOT q.boot AND (r.ep IS NULL OR r.ep <> q.ep))"
_BASE = f"concat_ws('+', CASE WHEN q.rtt THEN 'rtt' END, CASE WHEN {_E} > 0 THEN 'events' END)"
_WHY = f"concat_ws('+', nullif({_BASE}, ''), CASE WHEN {_D} >= 2 OR ({_D} = 1 AND {_BASE} <> '') THEN 'drops' END)"
CONTROL = _walk(
    """p AS (SELECT connection_id, ts_ms//60 AS ts_ms, id, (id//40) % 4 = 1 AS hot, value*10 AS rtt_ms, CASE WHEN id % 97 = 0 THEN 2 ELSE 0 END AS dr, id % 1501 = 0 AS boot FROM v_metric),
      a AS (SELECT *, sum(CASE WHEN boot THEN 1 ELSE 0 END) OVER w AS bt, row_number() OVER w AS n, sum(CASE WHEN NOT (hot AND NOT boot) THEN 1 ELSE 0 END) OVER w AS ep FROM p WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms, id)),
      b AS (SELECT *, n - coalesce(max(CASE WHEN NOT (hot AND NOT boot) THEN n END) OVER (PARTITION BY connection_id ORDER BY n), 0) AS st,
        list_sort(list(rtt_ms) OVER (PARTITION BY connection_id, bt ORDER BY n ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) AS rs FROM a),
      src AS (SELECT b.connection_id, b.ts_ms, b.id, b.ep, b.boot, coalesce(len(rs) >= 5 AND rtt_ms >= 100 AND rtt_ms >= rs[len(rs)//2 + 1]*4, false) AS rtt,
        coalesce((SELECT list(d.ts_ms) FROM (SELECT connection_id, ts_ms FROM p, range(2) WHERE dr = 2) d WHERE d.connection_id = b.connection_id AND d.ts_ms BETWEEN b.ts_ms - 60000 AND b.ts_ms), []) AS drops,
        coalesce((SELECT list(e.ts_ms) FROM (SELECT connection_id, ts_ms//60 AS ts_ms FROM v_metric WHERE value > 450) e WHERE e.connection_id = b.connection_id AND e.ts_ms BETWEEN b.ts_ms - 60000 AND b.ts_ms), []) AS events FROM b WHERE st >= 3 OR boot)""",
    "connection_id",
    "CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS BIGINT) AS id, CAST(NULL AS HUGEINT) AS ep, CAST(NULL AS BIGINT) AS fl, CAST(NULL AS VARCHAR) AS why",
    f"""q.ts_ms, q.id, CASE WHEN q.boot THEN NULL WHEN {_OPEN} AND {_WHY} <> '' THEN q.ep ELSE r.ep END, CASE WHEN q.boot OR ({_OPEN} AND {_WHY} <> '') THEN q.ts_ms ELSE r.fl END, CASE WHEN {_OPEN} AND {_WHY} <> '' THEN {_WHY} END""",
    "SELECT k AS connection_id, ts_ms, id, why AS reasons FROM r WHERE why IS NOT NULL",
)
