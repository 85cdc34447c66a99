"""Threshold alerts against one latch per setting, walked row by row."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetscope.streaming import detectors as D
from tests.conftest import rows

READINGS = "connection_id string, alert string, ts_ms bigint, id bigint, value double"
SUBSCRIBERS = "subscriber string, alert string, threshold double, above boolean"


def walked(readings, subscribers, factor=0.9):
    out, latched = [], {}
    for conn, alert, ts, i, value in sorted(readings, key=lambda r: r[2:4]):
        for name, wanted, limit, above in subscribers:
            limit = D.ALERT_DEFAULTS.get(wanted) if limit is None else limit
            if value is None or limit is None or wanted != alert:
                continue
            over = math.isnan(value) or value >= limit
            low = not math.isnan(value) and value < limit * factor
            under = not math.isnan(value) and value <= limit
            high = math.isnan(value) or value > limit * (2 - factor)
            crossed, recovered = (over, low) if above else (under, high)
            if crossed:
                if not latched.get((conn, name)):
                    out.append((name, conn, alert, ts, i, limit))
                latched[conn, name] = True
            elif recovered:
                latched[conn, name] = False
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_alerts_equal_one_latch_per_setting(spark, seed):
    rng = random.Random(seed)
    kinds = [*D.ALERT_DEFAULTS, "unknown"]
    limits = (None, -20.0, -1.0, 0.0, 10.0, 50.0, 55.0, 90.0, 100.0)
    subscribers = [(f"s{i}", rng.choice(kinds), rng.choice(limits), rng.random() < 0.5) for i in range(40)]
    values = (None, float("nan"), float("inf"), -21.0, -20.0, -1.0, 0.0, 9.0, 45.0, 50.0, 50.0 * 0.9, 55.0 * 1.1, 81.0, 90.0, 120.0)
    # most readings on one connection and alert, many of them of one time
    readings = [
        ("hot" if rng.random() < 0.8 else "c1", rng.choice(kinds[:2] if rng.random() < 0.8 else kinds), rng.randrange(40) * 7_200_000, i, rng.choice(values))
        for i in range(600)
    ]
    got = D.threshold_alerts(spark.createDataFrame(readings, READINGS), spark.createDataFrame(subscribers, SUBSCRIBERS))
    found = sorted((tuple(r) for r in got.select("subscriber", "connection_id", "alert", "ts_ms", "id", "limit_value").collect()), key=str)
    assert found == walked(readings, subscribers) and found


def test_alerts_on_empty_tables(spark):
    none, one = spark.createDataFrame([], READINGS), spark.createDataFrame([("c", "slowlog_count", 1, 1, 500.0)], READINGS)
    asked = spark.createDataFrame([("a", "slowlog_count", None, True)], SUBSCRIBERS)
    assert D.threshold_alerts(none, asked).count() == 0
    assert D.threshold_alerts(one, asked.limit(0)).count() == 0
    assert rows(D.threshold_alerts(one, asked), "subscriber", "limit_value") == [("a", 100.0)]


def test_count_upto_is_a_binary_search(spark):
    df = spark.range(0, 40).select(F.expr("transform(sequence(0L, id), x -> struct(x * 2 as v))").alias("a"), (F.col("id") * 3 - 9).alias("x"))
    got = df.withColumn("n", D.count_upto("a", "v", F.col("x"))).collect()
    assert all(r["n"] == sum(s["v"] <= r["x"] for s in r["a"]) for r in got)


def test_readings_never_meet_all_settings(spark):
    """A thousand settings and readings that cross few of them: what comes out of the changes is what was crossed."""
    alert = F.expr("if(id >= 0, 'slowlog_count', 'none')").alias("alert")
    asked = spark.range(1000).select(F.format_string("s%d", "id").alias("subscriber"), alert, (F.col("id") + 500.0).alias("threshold"), (F.col("id") >= 0).alias("above"))
    readings = spark.range(1000).select(F.lit("c").alias("connection_id"), alert, (F.col("id") * 1000).alias("ts_ms"), "id", (F.col("id") % 7 + 496.0).alias("value"))
    got = D.threshold_alerts(readings, asked)
    assert rows(got, "subscriber", "id") == [("s0", 4), ("s1", 5), ("s2", 6)]
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture
def plain(spark):
    """Shuffles as planned, so that partitions show how rows are dealt out."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def crossing(spark, kinds):
    """400 readings of each kind; every other one is over the default of its kind."""
    rows_ = spark.range(400 * len(kinds)).withColumn("alert", F.array(*map(F.lit, kinds))[(F.col("id") % len(kinds)).cast("int")])
    value = F.when(F.floor(F.col("id") / len(kinds)) % 2 == 0, 1000.0).otherwise(0.0)
    return rows_.select(F.lit("c").alias("connection_id"), "alert", (F.col("id") * 1000).alias("ts_ms"), "id", value.alias("value"))


def test_alerts_of_one_setting_spread_over_tasks(plain):
    """All subscribers share the default and one connection fires often: that product is not one task's."""
    n = 6_000
    # columns that no plan can take for constants, which would make the join a product
    asked = plain.createDataFrame([(f"s{i}", "slowlog_count", None, True) for i in range(n)], SUBSCRIBERS)
    got = D.threshold_alerts(crossing(plain, ["slowlog_count"]), asked.repartition(4))
    dealt = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in dealt) == n * 200
    assert len(dealt) > 1 and max(r["count"] for r in dealt) <= n * 200 / 2
    assert got.groupBy("subscriber").count().where("count = 200").count() == n


def test_crossed_limits_come_out_in_bounded_batches():
    rise = np.arange(200_000.0)
    limits = {"slowlog_count": {True: np.stack([rise, rise * 0.9, rise, np.ones(len(rise))])}}
    values = [150_000.0, 0.5, 90_000.0, 199_999.0, -1.0, 30.0]
    batch = pa.RecordBatch.from_pydict(
        {"connection_id": ["c"] * 6, "alert": ["slowlog_count"] * 6, "ts_ms": [*range(6)], "id": [*range(6)], "value": values, "_from": [None, *values[:-1]]}
    )
    made = [b.to_pandas() for b in D._crossed(iter([batch]), limits)]
    rows_of = pd.concat(made)
    assert all(len(b) <= D.MARK_ROWS or b["id"].nunique() == 1 for b in made) and len(made) > 3
    for i, (was, now) in enumerate(zip([None, *values[:-1]], values)):
        up = (rise <= now) & ~(rise <= was if was is not None else rise < -1)
        down = (rise * 0.9 > now) & (rise * 0.9 <= was) if was is not None else rise < -1
        for mark, want in ((1, up), (0, down)):
            assert sorted(rows_of[(rows_of["id"] == i) & (rows_of["_mark"] == mark)]["limit_value"]) == [*rise[want]]


def test_alerts_of_each_kind_spread_over_tasks(plain):
    kinds = ["slowlog_count", "memory_critical"]
    asked = plain.createDataFrame([(f"s{i}", kinds[i % 2], None, True) for i in range(8_000)], SUBSCRIBERS)
    got = D.threshold_alerts(crossing(plain, kinds), asked.repartition(4))
    dealt = got.groupBy("alert", F.spark_partition_id()).count().collect()
    for kind in kinds:
        own = [r["count"] for r in dealt if r["alert"] == kind]
        assert sum(own) == 4_000 * 200 and len(own) > 1
