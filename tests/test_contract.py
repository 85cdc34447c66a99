"""Driver contract, registry and agreement with the SQL statements on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fleetscope import catalog
from tests.conftest import SMALL
from tools.check_queries import TABLES, compare

REGISTRY = catalog.load()
FAST = sorted(REGISTRY.ORACLES)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "pattern" in df.columns


def test_every_blueprint_row_is_covered():
    covered = {tag for tags in REGISTRY.COVERS.values() for tag in tags.split()}
    wanted = {f"{k}{i}" for k, n in (("S", 17), ("P", 21), ("A", 44), ("J", 28), ("W", 18), ("T", 25), ("V", 26)) for i in range(1, n + 1)}
    assert wanted - covered == set()


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, name):
    problem, _ = compare(entry.queries()[name](spark, SMALL), duck, entry.oracle_sql()[name])
    assert problem is None, problem


def test_session_zone_does_not_change_times(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        problem, _ = compare_zone(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert problem is None


def compare_zone(spark):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    return compare(entry.queries()["activity_timeline"](spark, SMALL), connection, entry.oracle_sql()["activity_timeline"])
