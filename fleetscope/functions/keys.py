"""Key and command shapes as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a key segment as dynamic.
NUMERIC = r"\d+"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LONG_ALPHANUMERIC = r"[a-zA-Z0-9]{20,}"
SHORT_HEX = r"[0-9a-fA-F]{6,}"
OBJECT_ID = r"[0-9a-fA-F]{24}"
LONG_HEX = r"[0-9a-fA-F]{32,}"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
REPLACEMENT_CHAR = "�"
BLOB = "<blob>"
MAX_ARG_CHARS = 200

# Verbs by class.
READ_VERBS = ("GET", "MGET")
WRITE_VERBS = ("SET", "HSET", "HMSET", "HSETNX")
SCRIPT_VERBS = ("EVAL", "EVALSHA", "FCALL", "FCALL_RO")
KEYED_SCAN_VERBS = ("SSCAN", "HSCAN", "ZSCAN")


def _star_segments(key: Column, delimiter: str, patterns: Iterable[str]) -> Column:
    """Whole segments that match become ``*``, in one replacement over the key."""
    return F.regexp_replace(key, f"(?<![^{delimiter}])(?:{'|'.join(patterns)})(?![^{delimiter}])", "*")


def log_key_pattern(key: Column) -> Column:
    """Key with dynamic segments starred; the hex rule applies to delimited keys only."""
    whole = (NUMERIC, UUID, LONG_ALPHANUMERIC)
    segment = (*whole, SHORT_HEX)
    return (
        F.when(key.contains(":"), _star_segments(key, ":", segment))
        .when(key.contains("/"), _star_segments(key, "/", segment))
        .when(key.rlike(rf"\A(?:{'|'.join(whole)})\z"), "*")
        .otherwise(key)
    )


def keyspace_pattern(key: Column) -> Column:
    """Keyspace grouping: segments end at any of ``: . _ -`` and are joined with ``:``.

    Since ``-`` ends a segment, a UUID shows as its parts.
    """
    return _star_segments(F.translate(key, "._-", ":::"), ":", (NUMERIC, OBJECT_ID, LONG_HEX))


def key_prefix(verb: Column, key: Column) -> Column:
    """First key segment with a colon; null for search verbs, whose argument is an index."""
    named = (key.isNotNull()) & (key != "") & ~verb.startswith("FT.")
    return F.when(named, F.concat(F.split(key, "[:/]")[0], F.lit(":")))


def sanitize_args(args: Column) -> Column:
    """Arguments with long, binary or control-bearing values replaced by a marker."""
    return F.transform(
        args,
        lambda a: F.when(
            (F.length(a) > MAX_ARG_CHARS) | a.contains(REPLACEMENT_CHAR) | a.rlike(CONTROL_CHARS), BLOB
        ).otherwise(a),
    )


def glob_regex(glob: Column) -> Column:
    """Anchored regular expression of a ``*``/``?`` glob."""
    escaped = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    starred = F.regexp_replace(F.regexp_replace(escaped, r"\*", "(?s:.*)"), r"\?(?!s:)", "(?s:.)")
    return F.concat(F.lit("^"), starred, F.lit("$"))


def command_shape(args: Column) -> Column:
    """``VERB:arity``; scripts are told apart by their digest or function name."""
    verb = F.upper(args[0])
    script = F.coalesce(F.get(args, F.lit(1)), F.lit("<unknown>"))
    return F.when(verb.isin(*SCRIPT_VERBS), F.concat_ws(":", verb, script)).otherwise(
        F.concat_ws(":", verb, (F.size(args) - 1).cast("string"))
    )


def latency_bucket(verb: Column, first_arg: Column) -> Column:
    """``FT.SEARCH:<index>``, ``read``, ``write`` or null."""
    head = F.upper(verb)
    search = (head == "FT.SEARCH") & F.coalesce(first_arg != "", F.lit(False))
    return (
        F.when(search, F.concat(F.lit("FT.SEARCH:"), first_arg))
        .when(head.isin(*READ_VERBS), "read")
        .when(head.isin(*WRITE_VERBS), "write")
    )


def _option_value(args: Column, start: int, option: str) -> Column:
    """Value behind the last use of ``option`` among option tokens (values are not read as options)."""

    def step(state: Column, token: Column) -> Column:
        word = F.upper(token)
        takes_value = word.isin("COUNT", "MATCH", "TYPE")
        return F.when(
            state["pending"].isNotNull(),
            F.struct(
                F.when(
                    (state["pending"] == option)
                    & F.coalesce(F.regexp_extract(token, r"^\s*\+?(\d+)", 1).try_cast("bigint") > 0, F.lit(False)),
                    F.regexp_extract(token, r"^\s*\+?(\d+)", 1).try_cast("bigint"),
                )
                .otherwise(state["value"])
                .alias("value"),
                F.lit(None).cast("string").alias("pending"),
            ),
        ).otherwise(
            F.struct(
                state["value"].alias("value"), F.when(takes_value, word).alias("pending")
            )
        )

    seed = F.struct(
        F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("string").alias("pending")
    )
    tail = F.slice(args, start + 1, F.greatest(F.size(args) - start, F.lit(0)))
    return F.aggregate(tail, seed, step)["value"]


def scan_command(args: Column) -> Column:
    """``struct(verb, key, count, match)`` of a scan-family command, else null."""
    verb = F.upper(args[0])
    keyed = verb.isin(*KEYED_SCAN_VERBS)
    count = F.when(verb == "SCAN", _option_value(args, 2, "COUNT")).otherwise(
        _option_value(args, 3, "COUNT")
    )
    upper = F.transform(args, lambda a: F.upper(a))
    at = F.array_position(upper, "MATCH")
    match = F.when(at > 0, F.try_element_at(args, (at + 1).cast("int")))
    return F.when(
        keyed | (verb == "SCAN"),
        F.struct(
            verb.alias("verb"),
            F.when(keyed, F.coalesce(F.get(args, F.lit(1)), F.lit(""))).alias("key"),
            F.coalesce(count, F.lit(10).cast("bigint")).alias("count"),
            match.alias("match"),
        ),
    )


def major_version(version: Column) -> Column:
    return F.regexp_extract(version, r"^(\d+)", 1).try_cast("int")
