"""Trace export requests (JSON) to span rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.sources.schemas import OTLP_REQUEST


def flatten_attributes(attributes: Column) -> Column:
    """Typed key-values to a string map; the type order decides, and the last key wins."""
    text = lambda v: F.coalesce(
        v["stringValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"), v["intValue"], v["arrayValue"]
    )
    pairs = F.transform(attributes, lambda a: F.struct(a["key"].alias("key"), text(a["value"]).alias("value")))
    kept = F.filter(pairs, lambda p: p["value"].isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(kept, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def otlp_spans(requests: DataFrame, tracked_prefix: str, column: str = "body") -> DataFrame:
    """Spans of tracked scopes, and root spans of any scope for context."""
    body = requests.select(F.from_json(column, OTLP_REQUEST).alias("b"))
    resources = body.select(F.explode("b.resourceSpans").alias("r"))
    scopes = resources.select(
        F.try_element_at(
            F.filter("r.resource.attributes", lambda a: a["key"] == "service.name"), F.lit(1)
        )["value"]["stringValue"].alias("service"),
        F.explode("r.scopeSpans").alias("s"),
    )
    spans = scopes.select("service", F.coalesce("s.scope.name", F.lit("")).alias("scope"), F.explode("s.spans").alias("p"))
    parent = F.col("p.parentSpanId")
    root = parent.isNull() | (parent == "") | parent.rlike("^0+$")
    start = F.coalesce(F.col("p.startTimeUnixNano").try_cast("bigint"), F.lit(0))
    end = F.coalesce(F.col("p.endTimeUnixNano").try_cast("bigint"), F.lit(0))
    named = (F.coalesce("p.traceId", F.lit("")) != "") & (F.coalesce("p.spanId", F.lit("")) != "")
    return spans.where((F.col("scope").startswith(tracked_prefix) | root) & named).select(
        F.col("p.traceId").alias("trace_id"),
        F.col("p.spanId").alias("span_id"),
        F.when(~root, parent).alias("parent_id"),
        F.coalesce("p.name", F.lit("")).alias("name"),
        "scope",
        "service",
        F.coalesce("p.kind", F.lit(0)).alias("kind"),
        F.floor(start / 1_000_000).alias("start_ms"),
        F.greatest(F.lit(0), end - start).cast("bigint").alias("duration_ns"),
        F.coalesce("p.status.code", F.lit(0)).alias("status"),
        flatten_attributes(F.col("p.attributes")).alias("attributes"),
    )
