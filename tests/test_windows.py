"""Rows joined with the windows that hold them, against a plain loop."""

import random

from pyspark.sql import functions as F

from fleetscope.streaming.detectors import within


def test_within_is_the_plain_range_join(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.randint(-50, 400), i) for i in range(150)] + [("a", None, 900), (None, 5, 901)]
    spans = [(rng.choice("abc"), a, a + rng.randint(-5, 120), i) for i, a in enumerate(rng.choices(range(-60, 400), k=40))]
    spans += [("a", None, 50, 900), ("b", 10, None, 901), ("a", 100, 100, 902)]
    got = within(
        spark.createDataFrame(rows, "k string, ts_ms bigint, row bigint"),
        spark.createDataFrame(spans, "k string, opened bigint, closed bigint, span bigint"),
        ["k"], F.col("opened"), F.col("closed"), slot_ms=30,
    ).select("row", "span")
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    want = [
        (i, j) for k, t, i in known for key, a, b, j in spans if key == k and None not in (a, b) and a <= t <= b
    ]
    assert sorted(map(tuple, got.collect())) == sorted(want)
