"""Stream forms against history forms: rows out of order, three runs of one checkpoint, silent keys."""

import random
from typing import NamedTuple

import pytest
from pyspark.sql import functions as F

from fleetscope.streaming import detectors as D
from fleetscope.streaming import steps, wiring
from fleetscope.streaming.live import Live, live
from tests.conftest import rows


MINUTE = 60_000
FAR = 4_000 * MINUTE
#: Nothing happens at the epoch: a stream starts with a watermark of 0.
START = 60 * MINUTE


def arrivals(data, rng, parts=3, spread=8):
    """data in the order of arrival: each row at most ``spread`` places from its own, in parts."""
    order = sorted(range(len(data)), key=lambda i: i + rng.uniform(0, spread))
    size = -(-len(order) // parts)
    return [[data[i] for i in order[k : k + size]] for k in range(0, len(order), size)]


class Case(NamedTuple):
    """A detector, its rows in time order, and a far row of another key that moves the watermark at the end."""

    detector: Live
    data: list
    schema: str
    last: tuple
    lateness: str = "20 minutes"

    def files(self):
        one, two, three = arrivals(self.data, random.Random(1))
        return [[one], [two], [three, [self.last]]]


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """Of each case what came out of three runs of one checkpoint, and the last run."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    top = tmp_path_factory.mktemp("live")
    queries = {}
    for run in range(3):
        for name, case in CASES.items():
            source, out, state = (str(top / name / n) for n in ("in", "out", "state"))
            for part in case.files()[run]:
                spark.createDataFrame(part, case.schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(case.schema).option("maxFilesPerTrigger", 1).parquet(source)
            queries[name] = wiring.write_batches(live(stream, case.detector, case.lateness), out, state)
        for query in queries.values():
            query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    return {name: (spark.read.parquet(str(top / name / "out")).drop("batch"), query) for name, query in queries.items()}


def polls(seed, n, make, keys=("hot", "hot", "hot", "c1", "c2")):
    """Rows (connection, ts, id, ...) in time order, most of them of one connection."""
    rng = random.Random(seed)
    ts, held = START, []
    for i in range(n):
        ts += rng.choice((5_000, 15_000, 15_000, 40_000))
        held.append((rng.choice(keys), ts, i, *make(rng, i)))
    return held


def lockout_rows(rng, i):
    return (rng.choice((40, 90, 95, None)) if rng.random() < 0.4 else 90, 100 if rng.random() < 0.95 else None, i // 12 if rng.random() < 0.9 else None)


def load_rows(rng, i):
    return (rng.choice((100, 850, 850, 850, 960, 960, 1200)) if i % 9 < 6 else rng.choice((960, 970)), 1000)


def memory_rows(rng, i):
    used = 1000
    long = 100 < i % 200 < 160
    return (
        used, 1500 if long or rng.random() < 0.1 else rng.choice((100, 350, 450, 600)), 20, rng.choice((200, 300, 400)),
        rng.choice((None, 40.0)), rng.choice((1000, 1000, 0)), rng.choice(("noeviction", "allkeys-lru")), rng.choice((0, 5, None)),
    )


def fork_rows(rng, i):
    return (
        rng.random() < 0.5, rng.choice((500, 800)), rng.choice((None, 600, 850)), rng.choice((None, 50, 100)),
        rng.choice((None, 0, 300)), rng.choice((1000, 1000, 0, None)), rng.choice((None, 10.0, 2000.0)),
    )


def resync_rows(rng, i):
    down = i % 60
    return (rng.choice(("replica", "slave", "replica", "master")) if rng.random() < 0.02 else "replica", "up" if rng.random() < 0.01 else "down", down * 15 if rng.random() < 0.95 else None, rng.random() < 0.5)


def raft_rows(rng, i):
    return (rng.choice(("follower", "candidate", "candidate", "pre-candidate", "leader" if rng.random() < 0.2 else "candidate")), i // rng.choice((2, 3)), i // 40)


CONNECTION = "connection_id string, ts_ms bigint, id bigint"
MEMORY = f"{CONNECTION}, used bigint, overhead bigint, startup bigint, dataset bigint, dataset_pct double, maxmemory bigint, policy string, evicted_delta bigint"
FORK = f"{CONNECTION}, saving boolean, used bigint, rss bigint, cow bigint, last_cow bigint, system bigint, writes_per_sec double"
SIMPLE = {
    "client_lockout": (steps.client_lockout(), D.client_lockout, f"{CONNECTION}, clients bigint, max_clients bigint, rejected bigint", lockout_rows),
    "load_saturation": (steps.load_saturation(), D.load_saturation, f"{CONNECTION}, usec_per_cycle bigint, cycles_per_sec bigint", load_rows),
    "memory_overhead": (steps.memory_overhead(), D.memory_overhead, MEMORY, memory_rows),
    "fork_memory_risk": (steps.fork_memory_risk(), D.fork_memory_risk, FORK, fork_rows),
    "unexplained_resyncs": (steps.unexplained_resyncs(), D.unexplained_resyncs, f"{CONNECTION}, sync_full_delta bigint, replicas bigint", lambda rng, i: (rng.choice((0, 0, 1, 2)), rng.choice((2, 2, 3)))),
    "resync_loop": (steps.resync_loop(), D.resync_loop, f"{CONNECTION}, role string, link string, down_s bigint, syncing boolean", resync_rows),
    "raft_health": (steps.raft_health(), D.raft_health, f"{CONNECTION}, role string, term bigint, commit bigint", raft_rows),
}


def simple_case(name):
    detector, _, schema, make = SIMPLE[name]
    data = polls(3, 420, make)
    if name == "raft_health":  # a node's term only rises
        data = [(*r[:4], i // 4, r[5]) for i, r in enumerate(data)]
    return Case(detector, data, schema, ("other", FAR, 10**6, *make(random.Random(1), 0)))


ASKED = [
    ("a", "memory_critical", None, True), ("b", "memory_critical", 95.0, True), ("c", "memory_critical", 95.0, True), ("d", "memory_critical", -5.0, True),
    ("e", "slowlog_count", 60.0, False), ("f", "slowlog_count", None, True), ("g", "slowlog_count", 85.5, False), ("h", "nothing", None, True),
]


def threshold_case():
    rng = random.Random(4)
    values = (None, -5.0, 50.0, 82.0, 88.0, 95.0, 101.0, 130.0, 95.0 * 0.9)
    data = [(rng.choice(("hot", "c1")), rng.choice(("memory_critical", "slowlog_count")), START + i * 9_000, i, rng.choice(values)) for i in range(400)]
    return Case(steps.threshold_alerts(ASKED), data, "connection_id string, alert string, ts_ms bigint, id bigint, value double", ("other", "x", FAR, 0, 1.0))


CONTROL = f"{CONNECTION}, event boolean, cpu_pct double, rtt_ms double, replica_drops bigint, restart boolean"


def control_case():
    rng = random.Random(12)
    data, ts = [], START
    for i in range(900):
        ts += rng.choice((0, 5_000, 5_000, 20_000, 90_000))
        conn = rng.choice(("hot", "hot", "hot", "c1"))
        if rng.random() < 0.06:
            data.append((conn, ts, None, True, None, None, None, None))
        else:
            busy = rng.choice((95.0, 95.0, 91.0, None)) if i % 30 < 24 else 20.0
            rtt = rng.choice((None, 10.0, 20.0, 30.0, 30.0, 500.0 if rng.random() < 0.4 else 40.0))
            data.append((conn, ts, i, False, busy, rtt, rng.choice((0,) * 12 + (1, 1, 2)), rng.random() < 0.01))
    return Case(steps.control_plane_saturation(), data, CONTROL, ("other", FAR, 10**6, False, 1.0, None, 0, False))


def buffer_case():
    rng = random.Random(7)
    data = [
        (rng.choice(("hot", "c")), rng.choice("xy"), START + i * 8_000, i, rng.choice((10, 450, 450, 450, 700, 950)) if i % 40 < 25 else 650, 1000 if i % 80 < 40 else 2000, rng.choice((600, 700)), 30)
        for i in range(400)
    ]
    schema = "connection_id string, addr string, ts_ms bigint, id bigint, omem bigint, hard_bytes bigint, soft_bytes bigint, soft_seconds bigint"
    return Case(steps.replica_buffer_pressure(), data, schema, ("o", "o", FAR, 0, 1, 1, 1, 1))


def failover_case():
    rng = random.Random(9)
    data, epoch = [], 1
    for poll in range(150):
        epoch += rng.random() < 0.2
        for node in ("n1", "n2", "n3"):
            ts = START + poll * 10_000 + (200_000 if poll > 80 else 0)
            data.append(("hot", "s1", ts, node, epoch if rng.random() < 0.6 else epoch - 1, rng.random() < 0.9, rng.random() < 0.1, rng.random() < 0.05))
    schema = "connection_id string, shard string, ts_ms bigint, node_id string, epoch bigint, live boolean, unhealthy boolean, resharding boolean"
    return Case(steps.failover_churn(), data, schema, ("o", "o", FAR, "n", 1, True, False, False))


def save_case():
    rng = random.Random(2)
    data = []
    for i in range(400):
        busy, at = i % 50 > 5, i % 50
        data.append((
            "hot", rng.choice(("rdb", "aof")), START + i * 20_000, i, busy, at * 20 if busy else None,
            100 + at // 8 if rng.random() < 0.95 else None, 200, rng.choice(("ok", "ok", "err", None)),
        ))
    schema = "connection_id string, child string, ts_ms bigint, id bigint, in_progress boolean, elapsed_s bigint, processed bigint, total bigint, status string"
    return Case(steps.persistence_stall(), data, schema, ("o", "o", FAR, 0, False, None, None, None, "ok"))


def rejoin_case():
    rng = random.Random(6)
    data, away = [], {}
    for poll in range(160):
        for node in ("a", "b", "c", "d", "e"):
            if away.get(node, 0) > 0:
                away[node] -= 1
                continue
            if rng.random() < 0.06:
                away[node] = rng.choice((1, 2, 4, 9))
            if poll != 100 or node == "a":
                data.append(("hot", START + poll * 20_000, node, rng.random() < 0.9))
    return Case(steps.forget_rejoin(), data, "connection_id string, ts_ms bigint, node_id string, live boolean", ("o", FAR, "n", True))


ENTRIES = "connection_id string, entry_id bigint, ts_ms bigint, count bigint, created_ms bigint, reason string, client_info string, client_ip string"


def login_case():
    rng = random.Random(12)
    data, counts = [], {}
    for scan in range(200):
        for entry in range(6):
            counts[entry] = 0 if rng.random() < 0.02 else counts.get(entry, 0) + rng.choice((0, 0, 0, 1, 3))
            if rng.random() < (0.05 if 90 < scan < 140 else 0.8):
                reason = rng.choice(("auth", "auth", "key")) if entry == 0 else "auth"
                ip = f"10.0.0.{entry % 3}"
                data.append(("hot", entry, START + scan * 30_000, counts[entry], START + entry * 210_000, reason, f"id=1 addr={ip}:500{entry} x", ip))
    return Case(steps.auth_failure_bursts(), data, ENTRIES, ("o", 1, FAR, 0, 0, "auth", "addr=1:1", "1"))


def ceiling_case():
    rng = random.Random(3)
    data = [("hot", rng.choice(("read", "write")), START + i * 30_000, rng.choice((100.0, 900.0, 1500.0, 2500.0)) if i % 60 < 20 else 2000.0) for i in range(400)]
    return Case(steps.sla_breaches(1000.0), data, "connection_id string, bucket string, ts_ms bigint, p99 double", ("o", "o", FAR, 1.0))


def gate_case():
    rng = random.Random(5)
    times = [START + i * 15_000 for i in range(200)]
    ok = [("hot", t, None) for t in times if rng.random() < 0.85]
    findings = [("hot", t, s) for i, t in enumerate(times) for s in ("x", "y") if (i // (12 if s == "x" else 7)) % 2 and rng.random() < 0.97]
    return Case(steps.persistence_gate(60_000), sorted(ok + findings, key=lambda r: r[1]), "connection_id string, ts_ms bigint, signature string", ("o", FAR, None))


def admission_case():
    rng = random.Random(8)
    data = [(rng.choice(("hot", "hot", "k")), START + t, i) for i, t in enumerate(sorted(rng.randrange(600_000) for _ in range(400)))]
    return Case(steps.admitted_requests(5, 10_000), data, "rate_key string, ts_ms bigint, id bigint", ("o", FAR, 0))


def ring_case():
    rng = random.Random(8)
    data = [("c", START + i * MINUTE, i, rng.random(), rng.choice(("hit", "miss"))) for i in range(200)]
    return Case(steps.recent_similarity(30, 20 * MINUTE), data, "category string, ts_ms bigint, id bigint, score double, result string", ("o", FAR, 0, 0.0, "hit"))


def proposal_case():
    rng = random.Random(8)
    data = []
    for p in range(40):
        commands = [
            ("c0", None, "pending"), ("c1", "pending", rng.choice(("approved", "rejected", "applied"))), ("c1", "pending", "rejected"),
            ("c2", "approved", "applied"), ("c3", "pending", "approved"),
        ]
        data += [(f"p{p}", START + (p * 9 + k) * 10_000, p * 10 + k, *c) for k, c in enumerate(commands)]
    schema = "proposal_id string, ts_ms bigint, id bigint, command string, expected string, wanted string"
    return Case(steps.proposal_status(), data, schema, ("o", 40_000 * MINUTE, 0, "c", None, "pending"))


def counted(state, row):
    state["n"] = (state.get("n") or 0) + 1
    yield (row.ts_ms, state["n"])


def silence_case():
    counter = Live(("k",), ("ts_ms",), "n bigint", "ts_ms bigint, n bigint", counted, order=("ts_ms",), quiet_ms=10 * MINUTE)
    data = [("a", START + t * MINUTE) for t in (0, 5, 14, 24, 33, 60)] + [(f"k{i}", START + 70 * MINUTE + i) for i in range(30)]
    return Case(counter, data, "k string, ts_ms bigint", ("z", FAR), "200 minutes")


CASES = {name: simple_case(name) for name in SIMPLE} | {
    "thresholds": threshold_case(), "buffers": buffer_case(), "failovers": failover_case(), "saves": save_case(), "rejoins": rejoin_case(),
    "logins": login_case(), "ceilings": ceiling_case(), "gate": gate_case(), "admission": admission_case(), "ring": ring_case(),
    "proposals": proposal_case(), "silence": silence_case(), "control": control_case(),
}


def frame(spark, name):
    return spark.createDataFrame(CASES[name].data, CASES[name].schema)


def history(spark, name):
    df = frame(spark, name)
    if name in SIMPLE:
        return SIMPLE[name][1](df)
    if name == "thresholds":
        subscribers = spark.createDataFrame(ASKED, "subscriber string, alert string, threshold double, above boolean")
        return D.threshold_alerts(df.where("value is not null"), subscribers)
    if name == "control":
        return D.control_plane_saturation(df.where("not event").drop("event"), df.where("event").select("connection_id", "ts_ms"))
    if name == "gate":
        return D.persistence_gate(df.where("signature is not null"), df.where("signature is null").select("connection_id", "ts_ms"), 60_000)
    return {
        "buffers": D.replica_buffer_pressure, "failovers": D.failover_churn, "saves": D.persistence_stall, "rejoins": D.forget_rejoin,
        "logins": lambda d: D.auth_failure_bursts(d.drop("client_ip")), "ceilings": lambda d: D.sla_breaches(d, 1000.0),
        "admission": lambda d: D.admitted_requests(d, 5, 10_000),
    }[name](df)


@pytest.mark.parametrize("name", sorted(set(CASES) - {"ring", "proposals", "silence"}))
def test_stream_equals_history(spark, ran, name):
    found, want = ran[name][0], history(spark, name)
    columns = found.columns
    assert set(columns) <= set(want.columns)
    assert rows(found, *columns) == rows(want, *columns)
    assert found.count() > 2


def test_inputs_reach_every_kind(ran):
    kinds = lambda name, column: {r[column] for r in ran[name][0].collect()}
    assert kinds("thresholds", "subscriber") == set("abcdefg")
    assert kinds("buffers", "kind") == {"soft_sustained", "hard_approach"}
    assert len(kinds("saves", "reason")) >= 3
    assert {"rtt", "events", "drops"} <= set("+".join(kinds("control", "reasons")).split("+"))
    assert kinds("raft_health", "kind") == {"no_leader", "leader_recovered", "election_churn"}
    assert kinds("fork_memory_risk", "kind") == {"live", "projected"}
    assert kinds("memory_overhead", "kind") == {"accounting", "overhead"}


def test_ring_is_bounded_and_forgets(ran):
    got = {r["ts_ms"]: (r["n"], r["hits"]) for r in ran["ring"][0].collect()}
    data = CASES["ring"].data
    for i, row in enumerate(data):
        held = [r for r in data[: i + 1] if r[1] > row[1] - 20 * MINUTE][-30:]
        assert got[row[1]] == (len(held), sum(r[4] == "hit" for r in held))


def test_repeated_and_late_commands_change_nothing(ran):
    status, done, want = {}, set(), []
    for p, _, i, command, expected, wanted in CASES["proposals"].data:
        if (p, command) in done:
            continue
        done.add((p, command))
        moved = p not in status or (status[p] == expected and (expected, wanted) in steps.MOVES)
        if moved:
            status[p] = wanted
        want.append((i, moved, status[p]))
    assert sorted(map(tuple, ran["proposals"][0].select("id", "moved", "status").collect())) == sorted(want)


def test_silent_keys_are_forgotten_and_start_anew(ran):
    """After quiet_ms the count starts anew, and of 31 silent keys nothing is left in the store."""
    found, query = ran["silence"]
    got = sorted(((r["ts_ms"] - START) // MINUTE, r["n"]) for r in found.where("k = 'a'").collect())
    assert got == [(0, 1), (5, 2), (14, 3), (24, 1), (33, 2), (60, 1)]
    held = [b.stateOperators[0].numRowsTotal for b in query.recentProgress]
    assert max(held) > 31 and held[-1] <= 6  # the far key: state, time, timer and its waiting row


def test_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    schema = "rate_key string, ts_ms bigint, id bigint"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ([("k", 100 * MINUTE, 1)], [("k", 10 * MINUTE, 2), ("k", 99 * MINUTE, 3), (None, MINUTE, 4), ("k", None, 5)], [("o", FAR, 9)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        wiring.write_batches(live(stream, steps.admitted_requests(9, 1_000), "5 minutes"), out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "id") == rows(spark.createDataFrame([(1,), (3,)], "id bigint"))
