"""Registry of runnable queries with their independent SQL statements."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetscope.catalog.sql_views import CONNECTIONS, VIEWS
from fleetscope.catalog.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}
MODULES: dict[str, str] = {}
#: The statements as written, without the views they mention.
STATEMENTS: dict[str, str] = {}


def _with_views(sql: str) -> str:
    """Prefix the statement with the view definitions it mentions, dependencies first."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in wanted:
                need(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    heads = [f"{name} AS ({VIEWS[name]})" for name in wanted]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        rest = rest[10:] if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*heads, rest])
    return (("WITH " + ",\n".join(heads) + "\n") if heads else "") + body


def per_connection(sql: str, view: str) -> str:
    """The fleet's statement over ``view``, run on the rows of each connection alone."""
    parts = []
    for connection in CONNECTIONS:
        own = f"{connection}_{view[2:]}"
        rows = f"WITH {own} AS (SELECT * FROM {view} WHERE connection_id = '{connection}')"
        body = re.sub(rf"\b{view}\b", own, sql).strip()
        body = f"{rows}, {body[5:]}" if body[:5].upper() == "WITH " else f"{rows} {body}"
        parts.append(f"SELECT '{connection}' AS connection_id, * FROM ({body})")
    return " UNION ALL ".join(parts)


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``covers`` lists blueprint rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        COVERS[name] = covers
        MODULES[name] = fn.__module__
        if sql is not None:
            STATEMENTS[name] = sql
            ORACLES[name] = _with_views(sql)
        return fn

    return register
