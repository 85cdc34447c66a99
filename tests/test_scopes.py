"""Results per connection: those of A and B together, of A, are those of A alone."""

import random

import pytest
from pyspark.sql import functions as F

from fleetscope.catalog.connection_queries import CLIENT, KEYS, LOG
from fleetscope.catalog.views import ORIGIN_MS
from fleetscope.operators import clients, latency, logs
from fleetscope.operators.scopes import first_rows, with_totals
from tests.conftest import rows

MINUTE = 60_000
CLIENT_SCHEMA = (
    "connection_id string, id bigint, captured_ms bigint, name string, user_name string, addr string, cmd string, "
    "idle bigint, age bigint, qbuf bigint, omem bigint"
)
LOG_SCHEMA = (
    "connection_id string, id bigint, ts_ms bigint, log_type string, verb string, key string, value bigint, "
    "client_name string, client_addr string, args array<string>"
)


class Given:
    """Tables whose A is quiet, whose B is loud and the same clients and keys, and rows of no connection."""

    def __init__(self, spark, size=600):
        draw = random.Random(5)
        client, log = [], []
        for i in range(size):
            conn = ("A", "A", "B", None)[i % 4]
            loud = 1 if conn == "A" else 50
            client.append((
                conn, i, ORIGIN_MS + draw.randrange(30) * MINUTE * (1 if conn == "A" else 2), draw.choice(["", "svc1", "svc2"]),
                draw.choice(["default", "u1"]), f"10.0.0.{draw.randrange(4)}:{draw.randrange(3)}", draw.choice(["get", "set", ""]),
                draw.randrange(900), draw.randrange(99), draw.randrange(100_000) * loud, draw.randrange(1_000_000) * loud,
            ))
            verb, key = draw.choice([("GET", "user:1:x"), ("FT.SEARCH", "idx1"), ("SET", "job/77"), ("GET", "")])
            log.append((
                conn, i, ORIGIN_MS + 2 * 86_400_000 + draw.randrange(10**9), draw.choice(["slow", "large-reply"]), verb, key,
                draw.randrange(1000) * loud, draw.choice(["", "svc1"]), f"10.0.0.{draw.randrange(4)}:1", [verb, key],
            ))
        self.spark = spark
        self.client = spark.createDataFrame(client, CLIENT_SCHEMA).cache()
        self.log = spark.createDataFrame(log, LOG_SCHEMA).cache()

    def only(self, condition):
        picked = object.__new__(Given)
        picked.client, picked.log = self.client.where(condition), self.log.where(condition)
        return picked


@pytest.fixture(scope="module")
def given(spark):
    return Given(spark)


@pytest.mark.parametrize("name", sorted({**CLIENT, **LOG}))
def test_isolation(given, name):
    form = {**CLIENT, **LOG}[name]
    together = form(given)
    assert {r[0] for r in together.select("connection_id").distinct().collect()} <= {"A", "B"}
    assert rows(together.where("connection_id = 'A'")) == rows(form(given.only("connection_id = 'A'")))
    assert rows(form(given.only("false"))) == []


def test_loud_neighbour_hides_a_spike_from_the_fleet_only(spark):
    """B's level is far above A's spike, which is one beside A's own buckets."""
    at = lambda i: ORIGIN_MS + i * 5 * MINUTE
    data = [("B", at(i)) for i in range(20) for _ in range(200)]
    data += [("A", at(i)) for i in range(20) for _ in range(40 if i == 7 else 4)]
    frame = spark.createDataFrame(
        [(c, i, ts, "n", "u", "h:1", "get", 0, 0, 0, 0) for i, (c, ts) in enumerate(data)], CLIENT_SCHEMA
    )
    metric = F.col("metric") == "connections"
    assert rows(clients.client_spikes(frame).where(metric), "bucket_ms") == []
    assert rows(clients.client_spikes(frame, keys=KEYS).where(metric), "connection_id", "bucket_ms") == [("A", at(7))]


def test_shares_are_of_the_connection(given):
    for shares in (logs.log_patterns(given.log, KEYS), logs.log_breakdown(given.log, "command", KEYS)):
        for row in shares.groupBy("connection_id").agg(F.sum("pct").alias("all")).collect():
            assert row["all"] == pytest.approx(100)


def test_fleet_form_counts_rows_without_a_connection(given):
    counted = lambda df: df.agg(F.sum("n")).first()[0]
    assert counted(logs.log_patterns(given.log)) == 600
    assert counted(logs.log_patterns(given.log, KEYS)) == 450


def test_ties_and_totals(spark):
    df = spark.createDataFrame([("A", "x", 2), ("A", "y", 2), ("A", "z", 1), ("B", "y", 1)], "k string, c string, n int")
    order = [F.desc("n"), "c"]
    assert rows(first_rows(df, ["k"], order, 1), "k", "c") == [("A", "x"), ("B", "y")]
    assert rows(first_rows(df, [], order, 2), "k", "c") == [("A", "x"), ("A", "y")]
    assert {r["s"] for r in with_totals(df, [], s=F.sum("n")).collect()} == {6}
    assert rows(with_totals(df, ["k"], s=F.sum("n")), "k", "s") == [("A", 5), ("A", 5), ("A", 5), ("B", 1)]


def test_hot_connection_is_combined_before_the_shuffle(given):
    """Totals of a connection come from partial sums, and no single-row product joins them."""
    plan = logs.log_patterns(given.log, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_latest_events_of_each_connection(spark):
    events = spark.createDataFrame(
        [("A", "fork", 5, 1, 10), ("B", "fork", 9, 2, 3), ("A", "fork", 2, 3, 90), (None, "fork", 99, 4, 1)],
        "connection_id string, event string, ts_ms bigint, id bigint, value bigint",
    )
    assert rows(latency.latest_latency_events(events, KEYS)) == [("A", "fork", 5, 10, 90), ("B", "fork", 9, 3, 3)]
    assert rows(latency.latest_latency_events(events)) == [("fork", 99, 1, 90)]
