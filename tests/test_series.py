"""Slice-carrying series functions equal plain windows, on skewed keys and any partitioning."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.operators import series as S
from fleetscope.operators.quantiles import Quantile, exact_quantiles
from fleetscope.operators.timeseries import downsample, rolling_baseline
from tests.conftest import rows

KEYS, ORDER = ["k"], ["ts", "id"]


@pytest.fixture(scope="module")
def data(spark):
    """One key holds half of all rows; times bunch up and leave empty slices."""
    rng = random.Random(3)
    out = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
        ts = rng.choice([0, 5, 40]) * 3_600_000 + rng.randrange(7_200_000)
        out.append((key, ts, i, rng.randrange(1000), rng.randrange(1000) if rng.random() < 0.3 else None))
    return spark.createDataFrame(out, "k string, ts long, id long, v long, opt long").cache()


def plain():
    return Window.partitionBy("k").orderBy("ts", "id")


def test_previous(data):
    ours = S.with_previous(data, KEYS, ORDER, {"p": "v", "pt": "ts"})
    want = data.withColumn("p", F.lag("v").over(plain())).withColumn("pt", F.lag("ts").over(plain()))
    assert rows(ours, "id", "p", "pt") == rows(want, "id", "p", "pt")


def test_running_sum_and_index(data):
    ours = S.with_row_index(S.with_running_sum(data, KEYS, ORDER, {"s": "v"}), KEYS, ORDER, "i")
    whole = plain().rowsBetween(Window.unboundedPreceding, 0)
    want = data.withColumn("s", F.sum("v").over(whole)).withColumn("i", F.row_number().over(plain()) - 1)
    assert rows(ours, "id", "s", "i") == rows(want, "id", "s", "i")


def test_last_known(data):
    ours = S.with_last_known(data, KEYS, ORDER, {"l": "opt"})
    whole = plain().rowsBetween(Window.unboundedPreceding, 0)
    want = data.withColumn("l", F.last("opt", ignorenulls=True).over(whole))
    assert rows(ours, "id", "l") == rows(want, "id", "l")


def test_trailing_rows_across_chunks(data, monkeypatch):
    import builtins

    monkeypatch.setattr(S, "max", lambda a, b: 50 if b == 50_000 else builtins.max(a, b), raising=False)
    ours = S.over_trailing_rows(data, KEYS, ORDER, 20, {"s": F.sum("v"), "n": F.count("v")})
    frame = plain().rowsBetween(-19, 0)
    want = data.withColumn("s", F.sum("v").over(frame)).withColumn("n", F.count("v").over(frame))
    assert rows(ours, "id", "s", "n") == rows(want, "id", "s", "n")


def test_trailing_range(data):
    frame = Window.partitionBy("k").orderBy("ts")
    ours = S.over_trailing_range(data, KEYS, "ts", 600_000, {"s": F.sum("v")})
    want = data.withColumn("s", F.sum("v").over(frame.rangeBetween(-600_000, 0)))
    assert rows(ours, "id", "s") == rows(want, "id", "s")
    ours = S.over_trailing_range(data, KEYS, "ts", 5_000_000, {"s": F.sum("v")}, until=60_000)
    want = data.withColumn("s", F.sum("v").over(frame.rangeBetween(-5_000_000, -60_000)))
    assert rows(ours, "id", "s") == rows(want, "id", "s")


def test_partition_count_does_not_matter(data):
    one = rows(S.with_previous(data.repartition(1), KEYS, ORDER, {"p": "v"}), "id", "p")
    many = rows(S.with_previous(data.repartition(13), KEYS, ORDER, {"p": "v"}), "id", "p")
    assert one == many


def test_connection_isolation(data):
    both = S.with_running_sum(data, KEYS, ORDER, {"s": "v"}).where("k = 'hot'")
    alone = S.with_running_sum(data.where("k = 'hot'"), KEYS, ORDER, {"s": "v"})
    assert rows(both, "id", "s") == rows(alone, "id", "s")


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 0.95, 0.99])
def test_quantile_flavours(spark, p):
    rng = random.Random(7)
    values = [(f"k{i % 3}", rng.choice([-1.5, 0.0, 2.25, rng.random() * 1e6])) for i in range(999)]
    df = spark.createDataFrame(values, "k string, v double")
    got = {
        r["k"]: r
        for r in exact_quantiles(
            df, ["k"], "v", [Quantile("near", "nearest", p), Quantile("low", "floor", p), Quantile("mid", "linear", p)]
        ).collect()
    }
    import math

    for key in ("k0", "k1", "k2"):
        ordered = sorted(v for k, v in values if k == key)
        n = len(ordered)
        pos = (n - 1) * p
        low = math.floor(pos)
        assert got[key]["near"] == ordered[max(0, math.ceil(p * n) - 1)]
        assert got[key]["low"] == ordered[min(math.floor(p * n), n - 1)]
        assert got[key]["mid"] == pytest.approx(ordered[low] + (ordered[min(low + 1, n - 1)] - ordered[low]) * (pos - low))
        assert got[key]["n"] == n


def test_rolling_baseline_matches_direct(spark):
    rng = random.Random(1)
    cents = [rng.randrange(10_000) for _ in range(400)]
    df = spark.createDataFrame([("c", i * 60_000, i, c) for i, c in enumerate(cents)], "k string, ts long, id long, cents long")
    got = {r["id"]: r for r in rolling_baseline(df, KEYS, ORDER, "cents", rows=50, ready=10).collect()}
    for i in (0, 1, 9, 60, 399):
        window = cents[max(0, i - 49) : i + 1]
        mean = sum(window) / len(window)
        spread = (sum((c - mean) ** 2 for c in window) / len(window)) ** 0.5 if len(window) > 1 else 0.0
        assert got[i]["mean"] == pytest.approx(mean)
        assert got[i]["stddev"] == pytest.approx(spread)
        assert got[i]["ready"] == (len(window) >= 10)


@pytest.mark.parametrize("n,points", [(7, 10), (10, 10), (11, 10), (1000, 37), (100, 1)])
def test_downsample(spark, n, points):
    df = spark.range(n).select(F.lit("c").alias("k"), (F.col("id") * 1000).alias("ts"), "id")
    got = sorted(r["id"] for r in downsample(df, KEYS, ORDER, points).collect())
    want = list(range(n)) if n <= points else [int(i * (n / points)) for i in range(points - 1)] + [n - 1]
    assert got == want


@pytest.fixture(scope="module")
def burst(spark):
    """Most rows in one key and one hour, some of them in one minute; a few rows long before and after."""
    rng = random.Random(9)
    out = []
    for i in range(6000):
        if rng.random() < 0.9:
            key, ts = "hot", 30 * S.DAY_MS + 5 * S.HOUR_MS + (rng.randrange(S.HOUR_MS) if rng.random() < 0.7 else 1_000_000 + rng.randrange(60_000))
        else:
            key, ts = rng.choice(["hot", "a", "b"]), rng.randrange(60) * S.DAY_MS + rng.randrange(S.DAY_MS)
        out.append((key, ts, i, rng.randrange(1000), rng.randrange(1000) if rng.random() < 0.1 else None, rng.random() < 0.9))
    return spark.createDataFrame(out, "k string, ts long, id long, v long, opt long, up boolean").cache()


@pytest.mark.parametrize("width", [S.DAY_MS, S.HOUR_MS, 7 * S.DAY_MS])
def test_one_scan_over_data_sized_slices(burst, monkeypatch, width):
    monkeypatch.setattr(S, "SLICE_ROWS", 100)
    wanted = {"p": S.previous("v"), "l": S.last_known("opt"), "b": S.last_known("opt", before=True), "s": S.running_sum("v"), "n": S.streak("up")}
    ours = S.scan(burst, KEYS, ORDER, wanted, width)
    most = max(r["count"] for r in ours.groupBy("k", S.SLICE).count().collect())
    assert most <= (400 if width > S.DAY_MS else 250)  # even within the dense minute
    whole, earlier = (plain().rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    off = F.max(F.when(~F.col("up"), F.col("_n"))).over(whole)
    want = burst.withColumn("_n", F.row_number().over(plain())).select(
        "id", F.lag("v").over(plain()).alias("p"), F.last("opt", ignorenulls=True).over(whole).alias("l"),
        F.last("opt", ignorenulls=True).over(earlier).alias("b"), F.sum("v").over(whole).alias("s"),
        (F.col("_n") - F.coalesce(off, F.lit(0))).cast("bigint").alias("n"),
    )
    assert rows(ours, "id", "p", "l", "b", "s", "n") == rows(want, "id", "p", "l", "b", "s", "n")


def test_rows_are_dealt_out_once(spark, burst, tmp_path):
    """The rows and the summaries of one scan read the same shuffle."""
    burst.write.parquet(str(tmp_path / "t"))
    one = S.scan(spark.read.parquet(str(tmp_path / "t")), KEYS, ORDER, {"p": S.previous("v")})
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("REPARTITION_BY_COL" in x for x in plan.split("\n")) - plan.count("ReusedExchange") <= 1, plan


def test_a_second_scan_keeps_the_slices(burst):
    one = S.scan(burst, KEYS, ORDER, {"p": S.previous("v")})
    two = S.scan(one, KEYS, ORDER, {"s": S.running_sum("p")})
    assert rows(two, "id", "s") == rows(S.with_running_sum(S.with_previous(burst, KEYS, ORDER, {"p": "v"}), KEYS, ORDER, {"s": "p"}), "id", "s")


def test_scans_of_empty_tables(spark):
    none = spark.createDataFrame([], "k string, ts long, id long, v long")
    assert S.scan(none, KEYS, ORDER, {"p": S.previous("v"), "s": S.running_sum("v")}).collect() == []
