"""Medians of a trailing window against plain medians."""

import random
import statistics

import pytest

from fleetscope.operators import quantiles as Q

HOUR = 3_600_000
SCHEMA = "k string, ts_ms bigint, id int, v bigint, note string"


def plain(data, span, until):
    out = []
    for k, ts, i, _, note in data:
        if ts is None:
            continue
        seen = [v for kk, t, _, v, _ in data if kk == k and t is not None and v is not None and ts - span <= t <= ts - until]
        out.append((k, ts, i, note, float(statistics.median(seen)) if seen else None, len(seen)))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [HOUR // 2, 3 * HOUR])
def test_equals_plain_medians(spark, span, monkeypatch):
    monkeypatch.setattr(Q._Ordered, "BLOCK", 8)
    rng = random.Random(span)
    data = [
        ("hot" if rng.random() < 0.8 else rng.choice(("a", None)), rng.choice((None, *[rng.randrange(-8, 40) * HOUR // 4] * 20)), i, rng.choice((None, *range(12))), f"n{i}")
        for i in range(900)
    ]
    df = spark.createDataFrame(data, SCHEMA)
    got = Q.with_trailing_median(df, ["k"], "ts_ms", "v", span, HOUR // 4, "m", "n")
    found = sorted((tuple(r) for r in got.select("k", "ts_ms", "id", "note", "m", "n").collect()), key=str)
    assert found == plain(data, span, HOUR // 4)
    assert got.columns == [*df.columns, "m", "n"]


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Q.with_trailing_median(df, ["k"], "ts_ms", "v", HOUR, 1, "m", "n").count() == 0
    with pytest.raises(ValueError):
        Q.with_trailing_median(df, ["k"], "ts_ms", "v", HOUR, 0, "m", "n")


def test_ordered_values_in_small_blocks(monkeypatch):
    monkeypatch.setattr(Q._Ordered, "BLOCK", 4)
    rng = random.Random(5)
    kept, held = Q._Ordered(), []
    for _ in range(3000):
        if held and rng.random() < 0.47:
            x = held.pop(rng.randrange(len(held)))
            kept.remove(x)
        else:
            x = float(rng.randrange(60))
            held.append(x)
            kept.add(x)
        assert kept.median() == (statistics.median(held) if held else None)
        assert len(kept.blocks) <= len(held) and all(len(b) <= 4 for b in kept.blocks)


def test_cost_does_not_grow_with_the_frame():
    """100,000 values within one window: picking and adding stay in small blocks."""
    kept = Q._Ordered()
    for i in range(100_000):
        kept.add(float(i * 7919 % 100_003))
    assert max(map(len, kept.blocks)) <= Q._Ordered.BLOCK and len(kept.blocks) < 800
    assert kept.median() == statistics.median(float(i * 7919 % 100_003) for i in range(100_000))
