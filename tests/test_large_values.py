"""Byte gauges and long windows that overflow 64-bit products."""

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import keyspace, summaries, timeseries
from fleetscope.session import checkpoint_root
from fleetscope.streaming.wiring import split_late


@pytest.fixture
def gauge(spark):
    return spark.range(400).select(
        F.lit("c0").alias("connection_id"),
        F.lit("memory_used").alias("metric"),
        (F.col("id") * 1000).alias("ts_ms"),
        "id",
        (F.lit(10**14) + F.col("id") % 2).alias("units"),
    )


def test_baseline_of_large_values(gauge):
    last = timeseries.rolling_baseline(gauge, ["connection_id", "metric"], ["ts_ms", "id"], "units").where("id = 399").first()
    assert last["samples"] == 300
    assert last["stddev"] == pytest.approx(0.5)


def test_warmup_of_large_values(gauge):
    row = timeseries.buffer_warmup(gauge, ["connection_id", "metric"], ["ts_ms", "id"], "units").first()
    assert row["stddev"] == pytest.approx(0.5)


def test_forecast_of_large_values(gauge):
    rising = gauge.withColumn("units", F.lit(10**14) + F.col("id") * 10).withColumn("ts_ms", F.col("id") * 6_480_000)
    row = timeseries.forecast(rising, 0, 2_592_000_000).first()
    assert row["current_units"] == 10**14 + 3990


def test_overhead_of_large_values(spark):
    runs = spark.createDataFrame([("w", m, 10**12 + d) for m in (True, False) for d in (-3, 3)], "workload string, monitored boolean, units bigint")
    assert summaries.overhead_report(runs).first()["base_cv_pct"] == pytest.approx(3e-10)


def test_large_hashes_count(spark):
    sampled = spark.createDataFrame([("c", 50_000, True), ("c", 5, False)], "connection_id string, fields bigint, has_field_ttl boolean")
    totals = spark.createDataFrame([("c", 10)], "connection_id string, total_hashes bigint")
    assert keyspace.field_expiry_estimate(sampled, totals).first()["estimated_keys"] == 5
    cut = keyspace.field_expiry_estimate(sampled, totals, max_fields=10).first()
    assert (cut["sampled_hashes"], cut["oversized_skipped"], cut["estimated_keys"]) == (1, 1, 0)


def test_rows_without_arrival_stay(spark):
    rows = spark.createDataFrame([(1, 2), (1, None), (1, 500)], "ts_ms bigint, captured_ms bigint")
    in_time, late = split_late(rows, 100)
    assert (in_time.count(), late.count()) == (2, 1)


def test_a_stream_needs_a_shared_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            checkpoint_root(spark)
