"""Stream forms that close groups by timer or read another stream's table, against their history forms."""

import random

import pytest

from fleetscope.streaming import detectors as D
from fleetscope.streaming import steps, wiring
from fleetscope.streaming.live import live
from tests.conftest import rows
from tests.test_live import FAR, MINUTE, START, arrivals

ANOMALY = "connection_id string, ts_ms bigint, id bigint, metric string, anomaly_type string, severity string, saturated boolean"
SAMPLE = "connection_id string, command string, ts_ms bigint, p99_us double, major int, calls_per_min double"
DAY = 1_440 * MINUTE
METRICS = (
    "acl_denied blocked_clients cluster_state connections cpu_utilization evicted_keys fragmentation_ratio input_kbps keyspace_misses "
    "memory_used ops_per_sec output_kbps persistence_child replication_role slowlog_last_id"
).split()


def anomaly_rows():
    """Every rule is the first match of some window; a silent connection has one open group at the end."""
    rng = random.Random(11)
    planned = [
        [("cpu_utilization", "spike", True)], [("cpu_utilization", "spike", False)], [("memory_used", "spike", None)],
        [("memory_used", "spike", False), ("evicted_keys", "spike", False)], [("keyspace_misses", "spike", None), ("evicted_keys", "drop", None)],
        [("connections", "spike", None), ("connections", "drop", None)], [("connections", "drop", None), ("connections", "spike", None)],
        [("connections", "spike", None), ("ops_per_sec", "spike", None), ("memory_used", "spike", None)],
        [("connections", "spike", None), ("ops_per_sec", "spike", None)], [("connections", "drop", None), ("ops_per_sec", "drop", None)],
        *[[(m, "spike", None)] for m in METRICS], [(None, None, None)],
    ]
    data, at, number = [], START, 0
    for group in planned * 3 + [rng.sample([(m, rng.choice(("spike", "drop")), None) for m in METRICS], 4) for _ in range(60)]:
        at += rng.choice((4_000, 5_001, 6_000, 30_000))
        for k, (metric, kind, saturated) in enumerate(group):
            number += 1
            data.append(("hot" if number % 5 else "c1", at + k * rng.choice((0, 1_000, 2_500)), number, metric, kind, rng.choice(("info", "warning", "critical", None)), saturated))
    data.append(("silent", at, number + 1, "acl_denied", "spike", "critical", None))
    return sorted(data, key=lambda r: (r[1], r[2]))


def sample_rows():
    """Polls every four minutes over three days: an upgrade, a way back, another upgrade, and hot commands."""
    rng = random.Random(4)
    data = []
    for poll in range(1_080):
        ts = START + poll * 4 * MINUTE
        major = 8 if poll < 400 or 560 <= poll < 700 else 9
        for conn in ("hot", "c1"):
            if conn == "c1" and (poll % 3 or poll < 30):
                continue
            for n, command in enumerate(("get", "set", "scan", "rare")):
                base = 2_000.0 * (n + 1)
                slow = (command == "get" and 420 <= poll < 450) or (command == "scan" and 800 <= poll < 840) or (command == "set" and 300 <= poll < 380)
                p99 = None if rng.random() < 0.01 else base * (rng.choice((3.5, 4.0)) if slow else rng.uniform(0.9, 1.1))
                calls = None if rng.random() < 0.01 else 10.0 if command == "rare" else 100.0 + n
                data.append((conn, command, ts, p99, None if rng.random() < 0.02 else major, calls))
    return data


def run(spark, tmp, name, data, schema, last, detector, lateness="20 minutes"):
    """Output and last run of three runs of one checkpoint over rows out of order."""
    source, out, state = (str(tmp / f"{name}-{n}") for n in ("in", "out", "state"))
    parts = arrivals(data, random.Random(1))
    parts[-1:] = [parts[-1], [last]]
    query = None
    for files in ([parts[0]], [parts[1]], parts[2:]):
        for part in files:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = wiring.write_batches(live(stream, detector, lateness), out, state)
        query.awaitTermination()
    return spark.read.parquet(out).drop("batch"), query


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_anomaly_groups(spark, tmp_path):
    data = anomaly_rows()
    last = ("o", FAR, 0, "acl_denied", "spike", "info", None)
    found, query = run(spark, tmp_path, "groups", data, ANOMALY, last, steps.anomaly_groups())
    want = D.correlate(spark.createDataFrame(data, ANOMALY))
    got = D.with_pattern(found)
    assert rows(got, *want.columns) == rows(want)
    assert got.where("connection_id = 'silent'").count() == 1, "the open group of a silent connection is closed by its timer"
    assert {rule.pattern for rule in D.correlation_rules()} | {"unknown"} == {r["pattern"] for r in got.collect()}
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 6, "only the far connection is left in the store"


def test_upgrade_regressions(spark, tmp_path):
    data = sample_rows()
    last = ("o", "x", 40 * DAY, 1.0, 8, 1.0)
    found, _ = run(spark, tmp_path, "upgrades", data, SAMPLE, last, steps.upgrade_regressions(), "60 minutes")
    want = D.upgrade_regressions(spark.createDataFrame(data, SAMPLE))
    assert rows(found, *want.columns) == rows(want)
    assert found.count() >= 2


def test_sustained_regressions_read_judged_samples(spark, tmp_path):
    data = sample_rows()
    last = ("o", "x", 40 * DAY, 1.0, 8, 1.0)
    judged, _ = run(spark, tmp_path, "samples", data, SAMPLE, last, steps.judged_samples(), "60 minutes")
    assert judged.count() == len(data)
    assert {r["owned"] for r in judged.select("owned").distinct().collect()} == {True, False}
    schema = ", ".join(f"{c} {t}" for c, t in judged.dtypes)
    far = spark.createDataFrame([("o", "x", 41 * DAY, 1.0, False, False)], ["connection_id", "command", "ts_ms", "p99_us", "eligible", "owned"])
    table, out = str(tmp_path / "samples-out"), str(tmp_path / "regressions")
    for step in range(2):
        if step:
            far.coalesce(1).write.parquet(f"{table}/batch=far")
        stream = spark.readStream.schema(schema).parquet(f"{table}/batch=*")
        wiring.write_batches(live(stream, steps.sustained_regressions(), "60 minutes"), out, str(tmp_path / "state")).awaitTermination()
    want = D.sustained_regressions(spark.createDataFrame(data, SAMPLE))
    assert rows(spark.read.parquet(out), *want.columns) == rows(want)
    assert want.count() >= 2


def test_raft_times_of_each_poll(spark, tmp_path):
    schema = "connection_id string, ts_ms bigint, id bigint, role string, term bigint, commit bigint, node_timeout_ms bigint"
    rng = random.Random(7)
    data = []
    for i in range(300):
        role = rng.choice(("candidate", "follower", "follower", "pre-candidate" if i % 60 < 40 else "leader"))
        data.append(("hot", START + i * 10_000, i, role, i // 20, i // 70, rng.choice((20_000, 20_000, 2_000, None))))
    last = ("o", FAR, 10**6, "follower", 1, 1, None)
    found, _ = run(spark, tmp_path, "raft", data, schema, last, steps.raft_health(timed=True))
    want = D.raft_health(spark.createDataFrame(data, schema))
    assert rows(found, *want.columns) == rows(want)
    assert want.where("kind = 'no_leader'").count() > 1


def test_empty_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], ANOMALY).write.parquet(source)
    stream = live(spark.readStream.schema(ANOMALY).parquet(source), steps.anomaly_groups())
    wiring.write_batches(stream, out, str(tmp_path / "state")).awaitTermination()
    assert set(D.with_pattern(spark.createDataFrame([], stream.schema)).columns) >= {"pattern", "severity"}


def test_rows_without_saturation_or_metric(spark):
    """Null flags and metrics say nothing; the group is unknown."""
    df = spark.createDataFrame([("a", 1, 1, None, None, None, None)], ANOMALY)
    only = D.correlate(df).first()
    assert (only["n"], only["metrics"], only["pattern"], only["severity"]) == (1, "", "unknown", "info")
