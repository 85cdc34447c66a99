"""Full syncs after pressure against a walk over all sightings of the five minutes before."""

import random

import pytest

from fleetscope.streaming import detectors as D
from tests.conftest import rows

BUFFERS = "connection_id string, addr string, ts_ms bigint, id bigint, omem bigint, hard_bytes bigint, soft_bytes bigint, soft_seconds bigint"
SYNCS = "connection_id string, ts_ms bigint, sync_full_delta bigint"
FIVE = 300_000


def walked(buffers, syncs):
    out, fired = [], {}
    for conn, ts in sorted({(c, t) for c, t, n in syncs if c is not None and n}):
        seen = {}
        for c, addr, at, _, omem, hard, *_ in buffers:
            if c == conn and at <= ts and ts - at <= FIVE:
                seen[addr] = max(seen.get(addr, (-1, False)), (at, omem / hard >= 0.6))
        found = [(at, addr or "", addr) for addr, (at, pressured) in seen.items() if pressured and at < ts]
        if found and (conn not in fired or ts - fired[conn] >= FIVE):
            fired[conn] = ts
            out.append((conn, ts, max(found)[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_syncs_meet_the_last_sighting_of_each_replica(spark, seed):
    rng = random.Random(seed)
    # times fall on slot borders, on each other and exactly five minutes apart
    time = lambda: rng.choice((0, 55, 59, 60, 61, 65, 119, 125)) * 60_000 + rng.choice((0, 0, 1, 30_000))
    conn = lambda: rng.choice(("a", "b", None))
    buffers = [(conn(), rng.choice(("r1", "r2", "r3", None)), time(), i, rng.choice((10, 59, 60, 90)), 100, 0, 0) for i in range(80)]
    syncs = [(conn(), time(), rng.choice((0, 1, 1, 2, None))) for i in range(60)]
    got = D.resync_after_pressure(spark.createDataFrame(buffers, BUFFERS), spark.createDataFrame(syncs, SYNCS))
    want = walked(buffers, syncs)
    assert got.columns == ["connection_id", "ts_ms", "addr"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and want


def test_no_sync_is_paired_with_all_sightings_around_it(spark):
    """Rows of one connection and bucket: 300 sightings and 300 syncs would be 90,000 pairs of a join."""
    buffers = [("c", f"r{i % 3}", 10_000 + 2 * i, i, 90, 100, 0, 0) for i in range(300)]
    got = D.resync_after_pressure(
        spark.createDataFrame(buffers, BUFFERS), spark.createDataFrame([("c", 10_001 + 2 * i, 1) for i in range(300)], SYNCS)
    )
    assert rows(got) == [("c", 10_001, "r0")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # joins put carried values beside rows, by equality of all their keys; none compares times of two sides
    pairs = [line for line in plan.splitlines() if "Join Inner" in line]
    assert not pairs, pairs


def test_resyncs_on_empty_tables(spark):
    none, one = spark.createDataFrame([], BUFFERS), spark.createDataFrame([("c", "r", 1, 1, 90, 100, 0, 0)], BUFFERS)
    assert D.resync_after_pressure(none, spark.createDataFrame([("c", 2, 1)], SYNCS)).count() == 0
    assert D.resync_after_pressure(one, spark.createDataFrame([], SYNCS)).count() == 0
