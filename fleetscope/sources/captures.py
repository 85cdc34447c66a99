"""Captured command lines: parse, filter, export, redact."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r'^[0-9.]+\s+\[\d+\s+.+?\]\s+".+$'
STAMP = r"^([0-9.]+)\s"
DATABASE = r"^[0-9.]+\s+\[(\d+)\s"
ADDRESS = r'^[0-9.]+\s+\[\d+\s+(.+?)\]\s+"'
ARGUMENTS = r'^[0-9.]+\s+\[\d+\s+.+?\]\s+(".+)$'
TOKEN = r'"((?:[^"\\]|\\.|\\$)*)(?:"|$)'
LEADING_TOKENS = r'^((?:\s*"(?:[^"\\]|\\.|\\$)*(?:"|$))*)'
EXPORT_COLUMNS = ("ts", "ts_raw", "db", "addr", "cmd", "args", "key")
REDACTED = "<redacted>"

# Positions of values in write commands, the verb being position 0.
# verb: (first position, stride; 0 = that position only)
VALUE_POSITIONS = {
    "SET": (2, 0),
    "SETEX": (3, 0),
    "PSETEX": (3, 0),
    "SETNX": (2, 0),
    "GETSET": (2, 0),
    "APPEND": (2, 0),
    "LSET": (3, 0),
    "MSET": (2, 2),
    "MSETNX": (2, 2),
    "HSET": (3, 2),
    "HMSET": (3, 2),
    "HSETNX": (3, 0),
    "LPUSH": (2, 1),
    "RPUSH": (2, 1),
    "LPUSHX": (2, 1),
    "RPUSHX": (2, 1),
    "SADD": (2, 1),
    "SREM": (2, 1),
    "PUBLISH": (2, 0),
    "SPUBLISH": (2, 0),
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Capture files as lines; splittable, so a large capture spreads over tasks."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_capture(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds ts, ts_raw, db, addr, cmd, args, key; lines that do not parse are dropped."""
    line = F.col(column)
    tail = F.regexp_extract(line, ARGUMENTS, 1)
    run = F.regexp_extract(tail, LEADING_TOKENS, 1)
    tokens = F.transform(
        F.regexp_extract_all(run, F.lit(TOKEN), F.lit(1)), lambda t: F.when(t.contains("\\"), F.regexp_replace(t, r"\\(.)", "$1")).otherwise(t)
    )
    raw = F.regexp_extract(line, STAMP, 1)
    number = F.regexp_extract(raw, r"^(\d*\.?\d*)", 1).try_cast("double")
    parsed = lines.where(line.rlike(HEADER)).withColumn("_tokens", tokens).where(F.size("_tokens") > 0)
    return (
        parsed.withColumn("ts_raw", raw)
        .withColumn("ts", F.floor(number * 1000 + 0.5))
        .withColumn("db", F.regexp_extract(line, DATABASE, 1).cast("int"))
        .withColumn("addr", F.regexp_extract(line, ADDRESS, 1))
        .withColumn("cmd", F.upper(F.col("_tokens")[0]))
        .withColumn("args", F.slice("_tokens", 2, F.size("_tokens")))
        .withColumn("key", F.get("args", F.lit(0)))
        .drop("_tokens")
    )


def filter_capture(
    parsed: DataFrame,
    command: str | None = None,
    client: str | None = None,
    key_glob: str | None = None,
    after: int | None = None,
    before: int | None = None,
) -> DataFrame:
    out = parsed
    if command:
        out = out.where(F.col("cmd") == command.upper())
    if client:
        out = out.where(F.col("addr").contains(client))
    if key_glob:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in key_glob)
        out = out.where(F.col("key").rlike(f"^{pattern}$"))
    if after is not None:
        out = out.where(F.col("ts") >= after)
    if before is not None:
        out = out.where(F.col("ts") <= before)
    return out


def _csv_field(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\n]'), quoted).otherwise(value)


def csv_records(parsed: DataFrame) -> DataFrame:
    """One RFC-4180 record per line, as text."""
    fields = [
        F.col("ts").cast("string"),
        F.col("ts_raw"),
        F.col("db").cast("string"),
        F.col("addr"),
        F.col("cmd"),
        F.array_join("args", " "),
        F.coalesce("key", F.lit("")),
    ]
    return parsed.withColumn("record", F.concat_ws(",", *[_csv_field(f) for f in fields]))


def export_capture(parsed: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the capture as CSV with a header or as JSON lines, one file per task."""
    rows = parsed.select(*EXPORT_COLUMNS)
    if fmt == "csv":
        flat = rows.withColumn("args", F.array_join("args", " ")).na.fill({"key": ""})
        flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
            "emptyValue", ""
        ).csv(path)
    elif fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format {fmt}")


def redact_values(args: Column) -> Column:
    """Arguments with value positions of write commands replaced."""
    rules = F.create_map(
        *[
            x
            for verb, (first, stride) in VALUE_POSITIONS.items()
            for x in (F.lit(verb), F.struct(F.lit(first).alias("first"), F.lit(stride).alias("stride")))
        ]
    )
    verb = F.upper(F.get(args, F.lit(0)))
    rule = rules[verb]

    def mask(arg: Column, i: Column) -> Column:
        at = i - rule["first"]
        hit = (at == 0) | ((rule["stride"] > 0) & (at > 0) & (at % F.greatest(rule["stride"], F.lit(1)) == 0))
        insert = (verb == "LINSERT") & (F.size(args) >= 5) & i.isin(3, 4)
        return F.when(F.coalesce(hit, F.lit(False)) | insert, REDACTED).otherwise(arg)

    return F.transform(args, mask)
