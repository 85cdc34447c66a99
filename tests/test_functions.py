"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import fleet, identity, keys, scoring
from fleetscope.operators import captures, keyspace
from fleetscope.sources import captures as lines
from fleetscope.sources import dumps, sinks
from tests.conftest import rows

UUID = "123e4567-e89b-12d3-a456-426614174000"


def values(spark, fn, items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_log_key_pattern(spark):
    cases = {
        "user:123:name": "user:*:name",
        f"user:{UUID}": "user:*",
        "a/42/b": "a/*/b",
        "session:a1b2c3": "session:*",
        "a1b2c3": "a1b2c3",
        "12345": "*",
        "abcdefghij0123456789": "*",
        "plain": "plain",
        "a:b/123": "a:b/123",
        "1:2:3": "*:*:*",
        "x:": "x:",
        "n:12\n": "n:12\n",
    }
    assert values(spark, keys.log_key_pattern, cases) == list(cases.values())


def test_keyspace_pattern(spark):
    cases = {
        "user:123": "user:*",
        "cache_item-42.json": "cache:item:*:json",
        "o:507f1f77bcf86cd799439011": "o:*",
        "h:" + "a" * 32: "h:*",
        "h:a1b2c3": "h:a1b2c3",
        "a..b": "a::b",
    }
    assert values(spark, keys.keyspace_pattern, cases) == list(cases.values())


def test_scan_command(spark):
    df = spark.createDataFrame(
        [
            (0, ["HSCAN", "k", "0", "MATCH", "COUNT", "COUNT", "7"]),
            (1, ["scan", "0", "count", "abc"]),
            (2, ["SCAN", "0", "TYPE", "hash", "COUNT", "100", "NOVALUES"]),
            (3, ["GET", "k"]),
            (4, ["SSCAN"]),
            (5, ["SCAN", "0", "COUNT"]),
        ],
        "i int, a array<string>",
    )
    got = [r["s"] for r in df.orderBy("i").select(keys.scan_command(F.col("a")).alias("s")).collect()]
    assert [(g["verb"], g["key"], g["count"]) if g else None for g in got] == [
        ("HSCAN", "k", 7), ("SCAN", None, 10), ("SCAN", None, 100), None, ("SSCAN", "", 10), ("SCAN", None, 10),
    ]


def test_shapes_and_redaction(spark):
    df = spark.createDataFrame(
        [(0, ["eval", "sha", "1"]), (1, ["EVAL"]), (2, ["ping"]), (3, ["LINSERT", "k", "BEFORE", "p", "v"]), (4, ["mset", "a", "1", "b", "2"]), (5, ["RPUSH", "k", "x", "y"])],
        "i int, a array<string>",
    )
    shaped = [r[0] for r in df.orderBy("i").select(keys.command_shape(F.col("a"))).collect()]
    assert shaped[:3] == ["EVAL:sha", "EVAL:<unknown>", "PING:0"]
    red = [r[0] for r in df.orderBy("i").select(lines.redact_values(F.col("a"))).collect()]
    r = lines.REDACTED
    assert red[3] == ["LINSERT", "k", "BEFORE", r, r]
    assert red[4] == ["mset", "a", r, "b", r]
    assert red[5] == ["RPUSH", "k", r, r]


def test_parse_capture(spark):
    text = [
        '1700000000.123456 [0 127.0.0.1:5000] "get" "k"',
        '1700000000.5 [3 [::1]:5000] "SET" "a b" "say \\"hi\\" \\\\ x"',
        '1700000001 [0 unix:/tmp/s] "PING"',
        '1700000002.1 [0 a:1] "GET" "open',
        '1700000003.1 [0 a:1] "GET" "k" junk "more"',
        "nonsense",
        '1700000004 [x a:1] "GET"',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, line string")
    got = {r["i"]: r for r in lines.parse_capture(df).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert (got[0]["ts"], got[0]["db"], got[0]["addr"], got[0]["cmd"], got[0]["args"], got[0]["key"]) == (1700000000123, 0, "127.0.0.1:5000", "GET", ["k"], "k")
    assert (got[1]["addr"], got[1]["args"]) == ("[::1]:5000", ["a b", 'say "hi" \\ x'])
    assert got[2]["args"] == [] and got[2]["key"] is None
    assert got[3]["args"] == ["open"] and got[4]["args"] == ["k"]


def test_export_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([('1700000000.5 [0 a,b:1] "SET" "k" "x \\"y\\", z"',)], "line string")
    parsed = lines.parse_capture(df)
    lines.export_capture(parsed, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert back["args"] == 'k x "y", z' and back["addr"] == "a,b:1"
    lines.export_capture(parsed, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).first()["args"] == ["k", 'x "y", z']
    with pytest.raises(ValueError):
        lines.export_capture(parsed, str(tmp_path / "x"), "xml")


def test_audit_ip(spark):
    cases = {"id=1 addr=10.0.0.1:5 name=a": "10.0.0.1", "addr=[2001:db8::1]:99 x": "2001:db8::1", "addr=2001:db8::1:99": "2001:db8::1", "laddr=1.1.1.1:2": None}
    assert values(spark, identity.audit_ip, cases) == list(cases.values())


def test_percent_indexed_and_versions(spark):
    assert values(spark, fleet.percent_indexed, ["0.5", "1", "57", "x"]) == [50.0, 100.0, 57.0, 0.0]
    assert values(spark, keys.major_version, ["9.0.1", "x"]) == [9, None]


def test_tokens(spark):
    assert values(spark, scoring.token_set, ["The the (cat) sat. ...", ""]) == [["the", "cat", "sat"], []]
    assert values(spark, scoring.token_set_ascii, ["Éa-b é 'x'"]) == [["a-b", "x"]]


def test_cache_key_ignores_tool_order(spark):
    schema = "m string, msgs array<struct<content:string,role:string>>, tools array<struct<function:struct<name:string>,type:string>>"
    tool = lambda n: ((n,), "function")
    df = spark.createDataFrame([("m", [("hi", "user")], [tool("b"), tool("a")]), ("m", [("hi", "user")], [tool("a"), tool("b")]), ("m", [("hi", "user")], None)], schema)
    key = scoring.request_cache_key(F.col("m"), F.col("msgs"), tools=F.col("tools"))
    got = [r[0] for r in df.select(key).collect()]
    assert got[0] == got[1] != got[2]
    import hashlib

    assert got[2] == hashlib.sha256(b'{"messages":[{"content":"hi","role":"user"}],"model":"m","temperature":1,"top_p":1}').hexdigest()


def test_bulk_delete_refuses_everything(spark):
    df = spark.createDataFrame([("c", "a:1", "string", 5)], "connection_id string, key string, key_type string, memory_bytes long")
    for glob in ("", "  ", "*", "**"):
        with pytest.raises(ValueError):
            keyspace.pattern_delete_preview(df, glob)
    assert keyspace.pattern_delete_preview(df, "*", confirm_all=True).first()["matched"] == 1
    assert keyspace.matching_keys(df, "a.1").count() == 0 and keyspace.matching_keys(df, "a?1").count() == 1


def test_capture_is_not_compared_with_itself(spark):
    df = spark.createDataFrame([("a", "c", ["GET"], "k")], "capture_id string, connection_id string, args array<string>, key string")
    with pytest.raises(ValueError):
        captures.capture_diff(df, "a", "a")


def test_kv_entries_and_info(spark):
    df = spark.createDataFrame([("x", "lost:1\r\n# Server\r\nver:1:2\r\n#comment\r\n\r\n# Empty\r\n# Clients\r\n c:3 \r\n")], "id string, text string")
    assert rows(dumps.info_rows(df)) == [("x", "clients", "c", "3"), ("x", "server", "ver", "1:2")]
    got = values(spark, lambda v: dumps.kv_get(dumps.kv_entries(v, " "), "a"), ["a=1=2 b a=3", "=9 b=1", ""])
    assert got == ["3", None, None]


def test_upsert_and_whole_trace_retention(spark):
    stored = spark.createDataFrame([("k", 1, "old"), ("m", 5, "keep")], "k string, ts long, v string")
    new = spark.createDataFrame([("k", 1, "new"), ("m", 4, "stale"), ("n", 1, "add")], "k string, ts long, v string")
    assert rows(sinks.upsert(stored, new, ["k"], ["ts"]), "k", "v") == [("k", "new"), ("m", "keep"), ("n", "add")]
    spans = spark.createDataFrame([("a", 1), ("a", 9), ("b", 5)], "trace_id string, start_ms long")
    assert rows(sinks.retain_traces(spans, 5)) == [("b", 5)]
