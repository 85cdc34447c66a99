"""Folds against plain Python on random sequences, and stream runs against history runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetscope.streaming import detectors as D
from fleetscope.streaming import folds, wiring
from fleetscope.streaming.runner import fold_history
from tests.conftest import rows


def brute(sequence, step):
    """Run a fold over (key -> rows) in plain Python."""
    out = []
    for key, items in sequence.items():
        state = {}
        for item in items:
            out += [(key, *event) for event in step(state, item)]
            state = json.loads(json.dumps(state))  # the state must survive a checkpoint
    return sorted(out, key=str)


class Row:
    def __init__(self, **kw):
        self.__dict__.update(kw)


def series(seed, n=300, keys=("a", "b", "hot")):
    rng = random.Random(seed)
    out = {k: [] for k in keys}
    ts = 0
    for i in range(n):
        ts += rng.choice([1, 500, 900, 5_000, 70_000])
        key = "hot" if rng.random() < 0.5 else rng.choice(keys)
        out[key].append((ts, i, rng.random()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limit(spark, seed):
    data = series(seed)
    df = spark.createDataFrame([(k, t, i) for k, v in data.items() for t, i, _ in v], "rate_key string, ts_ms long, id long")
    got = rows(D.admitted_requests(df, 3, 10_000))
    want = brute({k: [Row(ts_ms=t, id=i) for t, i, _ in v] for k, v in data.items()}, folds.rate_limit(3, 10_000))
    assert [tuple(map(str, r)) for r in sorted(got, key=str)] == [tuple(map(str, r)) for r in want]
    for key, items in data.items():
        admitted = [r[1] for r in got if r[0] == key and r[3]]
        assert all(sum(1 for u in admitted if t - 10_000 < u <= t) <= 3 for t in admitted)


@pytest.mark.parametrize("seed", [3, 4])
def test_anchored_windows(spark, seed):
    data = series(seed)
    df = spark.createDataFrame([(k, t, i) for k, v in data.items() for t, i, _ in v], "connection_id string, ts_ms long, id long")
    got = rows(D.anchor_windows(df, 1_000), "id", "start_ms")
    want = []
    for items in data.values():
        start = None
        for t, i, _ in items:
            if start is None or t - start > 1_000:
                start = t
            want.append((i, start))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("consecutive,cooldown,drops", [(1, 60_000, False), (3, 0, True), (2, 5_000, False)])
def test_spikes_equal_reference_loop(spark, consecutive, cooldown, drops):
    rng = random.Random(consecutive)
    data = []
    for k in ("a", "hot"):
        ts = 0
        for i in range(400):
            ts += rng.choice([1_000, 3_000, 30_000])
            value = 500.0 if rng.random() < 0.15 else rng.randrange(100) / 1.0
            data.append((k, "m", ts, i, value, int(value * 100)))
    config = D.SpikeConfig(consecutive=consecutive, cooldown_ms=cooldown, detect_drops=drops, warning_value=450.0)
    df = spark.createDataFrame(data, "connection_id string, metric string, ts_ms long, id long, value double, cents long")
    got = rows(D.spike_events(df, config), "connection_id", "id", "severity", "anomaly_type")

    want = []
    for key in ("a", "hot"):
        held, count, fired = [], 0, None
        for _, _, ts, i, value, cents in [r for r in data if r[0] == key]:
            held = (held + [cents])[-300:]
            if len(held) < 30 or (fired is not None and ts - fired < cooldown):
                continue
            n, s, q = len(held), sum(held), sum(c * c for c in held)
            spread = (n * q - s * s) ** 0.5 / n
            z = 0 if spread == 0 else (cents - s / n) / spread
            if z < 0 and not drops:
                continue
            severity = "critical" if abs(z) >= 3 else "warning" if abs(z) >= 2 else "warning" if value >= 450 else None
            if severity is None:
                count = 0
                continue
            count += 1
            if count >= consecutive:
                fired, count = ts, 0
                want.append((key, i, severity, "spike" if z > 0 else "drop"))
    assert got == sorted(want, key=lambda r: tuple((False, str(v)) for v in r))
    assert want


def test_stream_equals_history_across_restarts(spark, tmp_path):
    """Files arrive in three runs of one checkpointed query; the alerts equal one pass over history."""
    rng = random.Random(11)
    config = D.SpikeConfig(consecutive=2, cooldown_ms=5_000)
    data = []
    for i in range(600):
        value = 400.0 if rng.random() < 0.2 else float(rng.randrange(100))
        data.append((rng.choice(["c0", "hot"]), "m", i * 1_000, i, value))
    schema = "connection_id string, metric string, ts_ms long, id long, value double"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):
        chunk = [r for r in data if r[3] // 200 == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(source)
        stream = wiring.spike_stream(wiring.metric_stream(spark, source), config)
        wiring.write_batches(stream, out, state).awaitTermination()
    got = rows(spark.read.parquet(out), "connection_id", "id", "severity")
    history = spark.createDataFrame(data, schema).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    assert got == rows(D.spike_events(history, config), "connection_id", "id", "severity")
    assert got


def test_fold_stream_runs_any_step(spark, tmp_path):
    data = [("k", t, i) for i, t in enumerate(range(0, 40_000, 1_000))]
    schema = "connection_id string, ts_ms long, id long"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    wiring.write_batches(wiring.anchor_stream(stream, 5_000), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "id", "start_ms")
    want = rows(D.anchor_windows(spark.createDataFrame(data, schema), 5_000), "id", "start_ms")
    assert got == want


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    schema = "connection_id string, ts_ms long, id long, captured_ms long"
    data = [("c", i * 1_000, i, i * 1_000 + (90_000 if i % 10 == 0 else 10)) for i in range(50)]
    data += data[:5]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    wiring.late_and_in_time(stream, str(tmp_path / "out"), 60_000, ["id"], str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/in_time")).count() == 45
    assert spark.read.parquet(str(tmp_path / "out/late")).select("id").distinct().count() == 5


def test_span_dedupe_stream(spark, tmp_path):
    spans = [(f"t{i % 2}", f"s{i % 5}", i * 1_000) for i in range(30)]
    schema = "trace_id string, span_id string, start_ms long"
    spark.createDataFrame(spans, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    wiring.write_batches(wiring.dedupe_spans(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "trace_id", "span_id") == sorted({(a, b) for a, b, _ in spans})


def test_session_stream_equals_history(spark, tmp_path):
    reads = [("t", t, i) for i, t in enumerate((0, 1_000, 9_000, 20_000, 21_000, 90_000))]
    data = spark.createDataFrame(reads, "thread_id string, ts_ms long, id long")
    data.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("thread_id string, ts_ms long, id long, ts timestamp").parquet(str(tmp_path / "in"))
    spans = D.session_stream(stream, "5 seconds", "1 second")
    wiring.write_batches(spans, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(F.unix_millis("start").alias("start_ms"), "touches"))
    want = rows(D.session_intervals(data, 5_000), "start_ms", "touches")
    # the last session stays open until the watermark passes it
    assert set(got) == {r for r in want if r[0] < 90_000}


def test_raft_outage(spark):
    polls = [("follower", 1, 5)] * 2 + [("pre-candidate", 1, 5), ("follower", 1, 5)] * 6 + [("leader", 2, 6)]
    df = spark.createDataFrame(
        [("c", i * 10_000, i, r, t, c) for i, (r, t, c) in enumerate(polls)],
        "connection_id string, ts_ms long, id long, role string, term long, commit long",
    )
    got = [r["kind"] for r in D.raft_health(df).orderBy("ts_ms").collect()]
    assert got == ["no_leader", "leader_recovered"]


def test_raft_single_seek_then_quiet_is_no_outage(spark):
    polls = [("pre-candidate", 1, 5)] + [("follower", 1, 5)] * 8
    df = spark.createDataFrame(
        [("c", i * 10_000, i, r, t, c) for i, (r, t, c) in enumerate(polls)],
        "connection_id string, ts_ms long, id long, role string, term long, commit long",
    )
    assert D.raft_health(df).count() == 0


def test_raft_times_follow_the_node_timeout(spark):
    """At 20 s an outage is told 80 s after its first seek; at 2 s after 40 s; an unknown timeout counts as 15 s, 60 s."""
    told = {}
    for timeout, conn in ((20_000, "slow"), (2_000, "fast"), (None, "unknown"), (10**9, "clamped")):
        polls = [(conn, i * 10_000, i, "candidate", 1, 5, timeout) for i in range(200)]
        told[conn] = polls
    df = spark.createDataFrame(
        [p for polls in told.values() for p in polls],
        "connection_id string, ts_ms long, id long, role string, term long, commit long, node_timeout_ms long",
    )
    got = rows(D.raft_health(df).where("kind = 'no_leader'"), "connection_id", "ts_ms")
    assert got == [("clamped", 1_200_000), ("fast", 40_000), ("slow", 80_000), ("unknown", 60_000)]


def test_raft_quiet_of_a_slow_node_is_no_recovery(spark):
    """Seeks 50 s apart are one outage at a timeout of 20 s, and none at the fixed 30 s."""
    polls = [("c", i * 10_000, i, "candidate" if i % 5 == 0 else "follower", 1, 5, 20_000) for i in range(20)]
    schema = "connection_id string, ts_ms long, id long, role string, term long, commit long, node_timeout_ms long"
    df = spark.createDataFrame(polls, schema)
    assert rows(D.raft_health(df), "ts_ms", "kind") == [(100_000, "no_leader")]
    assert D.raft_health(df.drop("node_timeout_ms")).count() == 0


def test_election_churn(spark):
    df = spark.createDataFrame(
        [("c", i * 10_000, i, "leader", term, 1) for i, term in enumerate([1, 2, 3, 4, 4, 4])],
        "connection_id string, ts_ms long, id long, role string, term long, commit long",
    )
    assert rows(D.raft_health(df), "ts_ms", "kind") == [(30_000, "election_churn")]


def stall_polls(spark, polls):
    return spark.createDataFrame(
        [("c", "rdb", i * 30_000, i, *p) for i, p in enumerate(polls)],
        "connection_id string, child string, ts_ms long, id long, in_progress boolean, elapsed_s long, processed long, total long, status string",
    )


def test_persistence_stall_rules(spark):
    frozen = [(True, i * 30, min(i, 2), 10, "ok") for i in range(6)]
    assert [r["reason"] for r in D.persistence_stall(stall_polls(spark, frozen)).orderBy("ts_ms").collect()] == ["stall"]
    finished = [(True, i * 30, 10, 10, "ok") for i in range(4)]
    assert D.persistence_stall(stall_polls(spark, finished)).count() == 0
    failing = [(False, -1, None, None, s) for s in ("ok", "err", "err", "ok", "err")]
    assert [r["reason"] for r in D.persistence_stall(stall_polls(spark, failing)).collect()] == ["error", "error"]
    slow = [(True, i * 130, i, 100, "ok") for i in range(6)]
    assert [r["reason"] for r in D.persistence_stall(stall_polls(spark, slow)).orderBy("ts_ms").collect()] == ["long", "exceeded"]


def test_failover_churn(spark):
    def nodes(owners):
        return spark.createDataFrame(
            [("c", i * 10_000, "0-100", f"n{o}", e, True, False, False) for i, (o, e) in enumerate(owners)],
            "connection_id string, ts_ms long, shard string, node_id string, epoch long, live boolean, unhealthy boolean, resharding boolean",
        )

    churn = [(1, 1), (2, 2), (1, 3), (2, 4), (1, 5), (2, 6), (1, 7)]
    assert rows(D.failover_churn(nodes(churn)), "ts_ms", "severity") == [(30_000, "warning"), (60_000, "critical")]
    calm = [(1, 1), (1, 1), (2, 2), (2, 2)]
    assert D.failover_churn(nodes(calm)).count() == 0


def test_forget_rejoin(spark):
    def sightings(polls):
        data = [("c", i * 40_000, node, live) for i, seen in enumerate(polls) for node, live in seen]
        return spark.createDataFrame(data, "connection_id string, ts_ms long, node_id string, live boolean")

    base = [("a", True), ("b", True), ("d", True)]
    gone = [x for x in base if x[0] != "b"]
    got = rows(D.forget_rejoin(sightings([base, gone, gone, gone, base])))
    assert got == [("c", "b", 40_000, 160_000, 3)]
    assert D.forget_rejoin(sightings([base, gone, base])).count() == 0
    dead = [("a", True), ("b", False), ("d", True)]
    assert rows(D.forget_rejoin(sightings([base, gone, gone, dead, base]))) == [("c", "b", 40_000, 160_000, 2)]
    alone = [("a", True)]
    assert D.forget_rejoin(sightings([base, alone, alone, alone, base])).count() == 0


def test_miss_cost_pairs_oldest_pending(spark):
    data = [("p", 0, 1, "miss", None), ("p", 1_000, 2, "miss", None), ("p", 2_000, 3, "store", 7), ("p", 400_000, 4, "store", 9)]
    df = spark.createDataFrame(data, "prompt string, ts_ms long, id long, kind string, cost long")
    assert rows(D.miss_cost_backfill(df)) == [("p", 1, 3, 7)]


FACTS = [
    # existing, incoming (statement, date, tombstone) -> ops
    ([("dark", None)], [("dark", None, False)], ["noop"]),
    ([("dark", "2024-01-01")], [("light", "2024-02-01", False)], ["update"]),
    ([("dark", "2024-03-01")], [("light", "2024-02-01", False)], ["noop"]),
    ([("dark", "2024-03-01")], [("light", None, False)], ["update"]),
    ([("dark", "2024-03-01")], [("", "2024-02-01", True)], ["noop"]),
    ([("dark", "2024-03-01")], [("", None, True), ("x", None, False)], ["delete", "add"]),
    ([], [("", None, True)], ["unmatched_tombstone"]),
    ([], [("a", None, False), ("a", "2024-01-01", False)], ["add", "update"]),
    ([("first", None), ("second", None)], [("second", None, False)], ["update"]),
]


@pytest.mark.parametrize("existing,incoming,ops", FACTS)
def test_reconcile_facts(spark, existing, incoming, ops):
    old = spark.createDataFrame(
        [("s", "Theme ", i, s, d) for i, (s, d) in enumerate(existing)] or [("other", "x", 0, "y", None)],
        "scope string, subject string, id long, statement string, date string",
    )
    new = spark.createDataFrame(
        [("s", "theme", i, s, d, t) for i, (s, d, t) in enumerate(incoming)],
        "scope string, subject string, seq long, statement string, date string, tombstone boolean",
    )
    got = [r["op"] for r in D.reconcile_facts(old, new).where("scope = 's'").orderBy("seq").collect()]
    assert got == ops


def load_reference(levels, hold=3):
    """Straight loop over bands of one connection."""
    out, last, acked, run = [], 0, 0, 0
    for i, level in enumerate(levels):
        if level == 0:
            last = acked = run = 0
            continue
        run = run + 1 if level == last else 1
        last = level
        acked = min(acked, level)
        if run >= hold and level > acked:
            acked = level
            out.append((i, level))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_load_saturation_equals_loop(spark, seed):
    rng = random.Random(seed)
    levels, level = [], 0
    for _ in range(400):
        if rng.random() < 0.3:
            level = rng.choice([0, 1, 2])
        levels.append(level)
    busy = {0: 0.1, 1: 0.85, 2: 0.97}
    df = spark.createDataFrame(
        [("c", i * 1_000, i, busy[x] * 1e6, 1.0) for i, x in enumerate(levels)],
        "connection_id string, ts_ms long, id long, usec_per_cycle double, cycles_per_sec double",
    )
    got = sorted((r["id"], r["level"]) for r in D.load_saturation(df).collect())
    assert got == load_reference(levels)
    assert got


@pytest.mark.parametrize("seed", range(3))
def test_client_lockout_equals_loop(spark, seed):
    rng = random.Random(seed)
    polls, rejected, clients = [], 0, 50
    for i in range(300):
        if rng.random() < 0.2:
            clients = rng.choice([50, 86, 90])
        rejected = 0 if rng.random() < 0.02 else rejected + (rng.random() < 0.15)
        polls.append((clients, None if rng.random() < 0.1 else 100, None if rng.random() < 0.1 else rejected))
    df = spark.createDataFrame(
        [("c", i * 1_000, i, *p) for i, p in enumerate(polls)],
        "connection_id string, ts_ms long, id long, clients long, max_clients long, rejected long",
    )
    want, base, streak, held = [], None, 0, 0
    for i, (c, m, r) in enumerate(polls):
        if m is None:
            continue
        delta = 0 if r is None or base is None else max(0, r - base)
        base = base if r is None else r
        streak = streak + 1 if c / m * 100 >= 85 else 0
        level = 2 if delta > 0 and streak >= 3 else 1 if delta > 0 or streak >= 3 else 0
        if level > held:
            want.append((i, level))
            held = level
        if level == 0:
            held = 0
    assert sorted((r["id"], r["level"]) for r in D.client_lockout(df).collect()) == want


def test_auth_bursts(spark):
    data = [("c", "e1", t, n, -1_000_000, "auth", "id=1 addr=10.0.0.9:77 name=") for t, n in ((0, 100), (60_000, 104), (120_000, 111), (180_000, 130))]
    data += [("c", "e2", 120_000, 3, 100_000, "auth", "id=2 addr=[::1]:80")]
    df = spark.createDataFrame(data, "connection_id string, entry_id string, ts_ms long, count long, created_ms long, reason string, client_info string")
    # the first sighting is a baseline: 4, then 4 + 7 = 11 within five minutes
    assert rows(D.auth_failure_bursts(df)) == [("c", "10.0.0.9", 120_000, 11)]


def test_persistence_gate_treats_failed_polls_as_gaps(spark):
    polls = spark.createDataFrame([("c", t) for t in (0, 1, 2, 5, 6, 9)], "connection_id string, ts_ms long")
    found = spark.createDataFrame([("c", "x", t) for t in (1, 2, 5, 9)], "connection_id string, signature string, ts_ms long")
    assert rows(D.persistence_gate(found, polls, 4)) == [("c", "x", 1, 5)]


def test_fold_reset_segments_do_not_change_results(spark):
    rng = random.Random(5)
    data = [("hot", i * 1_000, i, rng.random() < 0.3) for i in range(2_000)]
    df = spark.createDataFrame(data, "k string, ts_ms long, id long, quiet boolean")

    def step(state, row):
        if row.quiet:
            state.clear()
            return
        state["n"] = state.get("n", 0) + 1
        if state["n"] == 3:
            yield (row.id,)

    plain = rows(fold_history(df, ["k"], ["ts_ms"], step, "hit long"))
    cut = rows(fold_history(df, ["k"], ["ts_ms"], step, "hit long", reset=F.col("quiet"), slice_ms=60_000))
    assert plain == cut and plain


@pytest.mark.parametrize("seed", range(3))
def test_cuts_at_pauses_keep_results(spark, seed):
    draw = random.Random(seed)
    ts, hits, owners = 0, [], []
    for i in range(400):
        ts += draw.choice([0, 5_000, 10_000, 30_000, 60_000, 60_001, 120_000, 120_001, 400_000]) + 1
        hits.append(("a" if i % 3 else "b", ts))
        owners.append(("a", ts, i // 2 + draw.choice([0, 0, 1]), draw.choice(["x", "y"]), draw.random() < 0.1, []))
    hit_rows = spark.createDataFrame(hits, "k string, ts_ms long")
    for wait in (60_000, 120_000):
        for boundary in (False, True):
            run = [hit_rows, ["k"], ["ts_ms"], folds.cooldown(wait, boundary), "hit long"]
            assert rows(fold_history(*run), "k", "hit") == rows(fold_history(*run, slice_ms=600_000, forgets_ms=wait), "k", "hit")
    shard_rows = spark.createDataFrame(
        owners, "k string, ts_ms long, epoch long, owner string, resharding boolean, unhealthy array<string>"
    )
    run = [shard_rows, ["k"], ["ts_ms"], folds.failover_churn(), "hit long, n long, severity string"]
    plain = rows(fold_history(*run), "hit", "n", "severity")
    assert plain == rows(fold_history(*run, slice_ms=600_000, forgets_ms=120_000), "hit", "n", "severity")
    assert plain


def test_state_is_plain_json():
    state = {}
    step = folds.failover_churn()
    for i in range(5):
        list(step(state, Row(ts_ms=i, epoch=i, owner="n", unhealthy=[], resharding=False)))
    assert json.loads(json.dumps(state)) == state

