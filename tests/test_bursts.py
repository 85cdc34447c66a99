"""Failure bursts against a walk over all scans of the window before, and pauses of folds against one walk."""

import random

import pytest
from pyspark.sql import functions as F

from fleetscope.streaming import detectors as D
from fleetscope.streaming import folds
from fleetscope.streaming.runner import fold_history
from tests.conftest import rows

ENTRIES = "connection_id string, entry_id string, ts_ms bigint, count bigint, created_ms bigint, reason string, client_info string"


def walked(entries, window, needed, wait):
    grown, last = {}, {}
    for conn, entry, ts, count, created, reason, info in sorted(entries, key=lambda r: r[2]):
        if reason != "auth" or conn is None:
            continue
        at, c = last.get((conn, entry), (None, None))
        delta = max(0, count - c) if at is not None and ts - at < window * 4 else count if created >= ts - window else 0
        last[conn, entry] = ts, count
        key = conn, info[5:13]
        grown.setdefault(key, {}).setdefault(ts, 0)
        grown[key][ts] += delta
    out = []
    for key, found in grown.items():
        fired = None
        for ts in sorted(found):
            n = sum(d for at, d in found.items() if ts - window < at <= ts)
            if n >= needed and (fired is None or ts - fired > wait):
                fired = ts
                out.append((*key, ts, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_bursts_count_what_grew_in_the_window(spark, seed):
    rng = random.Random(seed)
    entries, ts = [], 3_500_000
    for i in range(200):
        ts += rng.choice((10_000, 50_000, 100_000, 300_000, 300_001, 900_000, 900_001))
        for e in range(3):
            if rng.random() < 0.7:
                entries.append((rng.choice(("c", "d", None)), f"e{e}", ts, rng.randrange(30), ts - rng.choice((0, 300_000, 400_000)), rng.choice(("auth", "auth", "key")), f"addr=10.0.0.{e % 2 + 1}:5000"))
    got = D.auth_failure_bursts(spark.createDataFrame(entries, ENTRIES))
    want = walked(entries, 300_000, 10, 900_000)
    assert got.columns == ["connection_id", "client_ip", "ts_ms", "failures"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and want


def test_no_row_sums_its_whole_window_again(spark):
    """A frame that slides by time adds up all its rows for each row; the sums are running ones."""
    entries = [("c", "e", 10_000 + i, i, 0, "auth", "addr=10.0.0.1:5000") for i in range(300)]
    got = D.auth_failure_bursts(spark.createDataFrame(entries, ENTRIES))
    assert rows(got) == [("c", "10.0.0.1", 10_010, 10)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan.lower() and "RangeFrame, -299999" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_a_fold_cut_at_pauses_equals_one_walk(spark, seed):
    rng = random.Random(seed)
    data, ts = [], 0
    for i in range(300):
        ts += rng.choice((1, 999, 1_000, 1_001, 2_500))
        data.append((rng.choice("ab"), ts))
    df = spark.createDataFrame(data, "k string, ts_ms bigint").withColumn("id", F.col("ts_ms"))
    whole = fold_history(df, ["k"], ["ts_ms"], folds.cooldown(1_000, True), "ts_ms bigint")
    cut = fold_history(df, ["k"], ["ts_ms"], folds.cooldown(1_000, True), "ts_ms bigint", forgets_ms=1_000)
    assert rows(cut) == rows(whole) and rows(cut)
