"""Fleet-shaped views derived from the provided tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators.series import with_running_sum

ORIGIN_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z, first instant of the event table


def epoch_ms(ts: str) -> Column:
    """Floored epoch milliseconds of a zone-less timestamp read as UTC, whatever the session zone."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts)).cast("timestamp")
    return F.floor(F.unix_micros(local) / 1000)


def svc(mod: int, column: str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) % mod).cast("string"))


class Tables:
    """The provided tables of one directory and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts_ms", epoch_ms("ts"))

    @cached_property
    def log(self) -> DataFrame:
        """Captured slow and large command entries."""
        eid = F.col("event_id")
        verb = (
            F.when(eid % 10 == 0, "HSCAN")
            .when(F.col("event_type") == "click", "GET")
            .when(F.col("event_type") == "view", "HGETALL")
            .when(F.col("event_type") == "purchase", "SET")
            .when(F.col("event_type") == "signup", "HSET")
            .otherwise("FT.SEARCH")
        )
        key = F.when(verb == "FT.SEARCH", svc(3, "user_id", "idx")).otherwise(
            F.concat_ws(":", "event_type", F.col("user_id").cast("string"), (eid % 50).cast("string"))
        )
        return self.events.select(
            svc(4, "user_id", "c").alias("connection_id"),
            eid.alias("id"),
            "ts_ms",
            F.when(eid % 5 == 0, "large-reply")
            .when(eid % 5 == 1, "large-request")
            .otherwise("slow")
            .alias("log_type"),
            verb.alias("verb"),
            key.alias("key"),
            F.floor(F.col("value") * 1000).alias("value"),
            self._client_name().alias("client_name"),
            self._client_addr().alias("client_addr"),
        ).withColumn(
            "args",
            F.when(
                F.col("verb") == "HSCAN",
                F.array("verb", "key", F.lit("0"), F.lit("COUNT"), F.lit("10")),
            ).otherwise(F.array("verb", "key")),
        )

    @staticmethod
    def _client_name() -> Column:
        return F.when(F.col("user_id") % 5 == 0, "").otherwise(svc(7, "user_id", "svc"))

    @staticmethod
    def _client_addr() -> Column:
        return F.concat(
            F.lit("10.0."),
            (F.col("user_id") % 16).cast("string"),
            F.lit("."),
            (F.col("user_id") % 250).cast("string"),
            F.lit(":"),
            (F.lit(40000) + F.col("event_id") % 1000).cast("string"),
        )

    @cached_property
    def client(self) -> DataFrame:
        """Client-list snapshots, one capture per hour."""
        return self.events.select(
            svc(4, "user_id", "c").alias("connection_id"),
            F.col("event_id").alias("id"),
            (F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000).alias("captured_ms"),
            self._client_name().alias("name"),
            F.when(F.col("user_id") % 3 == 0, "default")
            .otherwise(svc(3, "user_id", "u"))
            .alias("user_name"),
            self._client_addr().alias("addr"),
            F.col("event_type").alias("cmd"),
            ((F.col("event_id") * 7) % 900).alias("idle"),
            ((F.col("event_id") * 13) % 5000).alias("age"),
            F.floor(F.col("value") * 5000).alias("qbuf"),
            F.floor(F.col("value") * 50000).alias("omem"),
        )

    @cached_property
    def metric(self) -> DataFrame:
        return self.events.select(
            svc(4, "user_id", "c").alias("connection_id"),
            F.col("event_type").alias("metric"),
            "ts_ms",
            F.col("event_id").alias("id"),
            "value",
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        )

    @cached_property
    def counter(self) -> DataFrame:
        """Cumulative counters that restart every ten days."""
        epochs = self.metric.withColumn("epoch", F.floor(F.col("ts_ms") / 864_000_000))
        return with_running_sum(
            epochs,
            ["connection_id", "metric", "epoch"],
            ["ts_ms", "id"],
            {"total": F.floor("value")},
        ).select("connection_id", "metric", "ts_ms", "id", "total")

    @cached_property
    def span(self) -> DataFrame:
        eid = F.col("event_id")
        return self.events.select(
            svc(4, "user_id", "c").alias("connection_id"),
            F.floor(eid / 8).alias("trace_id"),
            eid.alias("span_id"),
            F.when(eid % 8 != 0, eid - eid % 8).alias("parent_id"),
            F.col("event_type").alias("scope"),
            svc(7, "user_id", "svc").alias("service"),
            F.col("ts_ms").alias("start_ms"),
            F.floor(F.col("value") * 1e6).alias("duration_ns"),
            F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"),
        )

    @cached_property
    def sim(self) -> DataFrame:
        """Similarity-window samples of a semantic cache."""
        score = F.col("value") / F.lit(1000.0)
        return self.events.select(
            F.col("event_id").alias("id"),
            "ts_ms",
            svc(3, "user_id", "cat").alias("category"),
            score.alias("score"),
            F.when(score <= 0.3, "hit").otherwise("miss").alias("result"),
            F.when(F.col("event_id") % 4 != 0, F.floor(F.col("value") * 10)).alias("cost_micros"),
        )

    @cached_property
    def key(self) -> DataFrame:
        """Sampled keys with their details."""
        line = F.col("l_linenumber")
        return self.table("lineitem").select(
            svc(4, "l_suppkey", "c").alias("connection_id"),
            F.concat(
                F.lit("part:"),
                F.col("l_partkey").cast("string"),
                F.lit(":"),
                F.col("l_orderkey").cast("string"),
                F.lit("-"),
                line.cast("string"),
            ).alias("key"),
            F.when(line % 3 == 0, "string")
            .when(line % 3 == 1, "hash")
            .otherwise("zset")
            .alias("key_type"),
            F.floor("l_extendedprice").alias("memory_bytes"),
            F.col("l_quantity").cast("bigint").alias("cardinality"),
            F.when(line % 2 == 0, F.round(F.col("l_discount") * 100).cast("bigint")).alias("freq"),
            ((F.col("l_orderkey") * 17) % 100_000).alias("idle_s"),
            F.when(F.col("l_returnflag") == "R", -1)
            .otherwise((F.col("l_orderkey") * 31) % 900_000)
            .alias("ttl_s"),
            F.col("l_orderkey").alias("order_key"),
            line.cast("bigint").alias("line_number"),
        )

    @cached_property
    def node(self) -> DataFrame:
        sid = F.col("s_suppkey")
        start = (sid * 160) % 16384
        return self.table("supplier").select(
            F.concat(F.lit("n"), sid.cast("string")).alias("node_id"),
            sid.alias("node_no"),
            F.concat(F.lit("10.1."), (sid % 8).cast("string"), F.lit("."), sid.cast("string"), F.lit(":6379")).alias(
                "address"
            ),
            F.col("s_nationkey").cast("bigint").alias("config_epoch"),
            F.when(sid % 4 == 3, "replica").otherwise("master").alias("role"),
            (sid % 17 == 0).alias("failed"),
            F.concat(F.lit("n"), (sid - sid % 4).cast("string")).alias("master_id"),
            start.alias("slot_start"),
            F.least(start + 170, F.lit(16383)).alias("slot_end"),
            F.floor(F.col("s_acctbal") * 100).cast("bigint").alias("gauge"),
        )

    @cached_property
    def vec(self) -> DataFrame:
        vid = F.col("vec_id")
        return self.table("embeddings").select(
            vid,
            "embedding",
            F.when(vid % 5 == 0, "query").otherwise("entry").alias("side"),
            svc(3, "label", "m").alias("model"),
            F.concat(F.lit("cat"), F.col("label").cast("string")).alias("category"),
            (vid * 7 % 1000).alias("cost_micros"),
            F.col("label").cast("bigint").alias("label"),
        )

    @cached_property
    def mem(self) -> DataFrame:
        vid = F.col("vec_id")
        created = F.lit(ORIGIN_MS) + vid * 3_600_000
        return self.table("embeddings").select(
            vid.alias("item_id"),
            "embedding",
            F.concat(F.lit("t"), F.col("label").cast("string")).alias("thread_id"),
            ((vid * 37 % 100) / F.lit(100.0)).alias("importance"),
            created.alias("created_ms"),
            (created + (vid * 11 % 50) * 86_400_000).alias("accessed_ms"),
        )

    @cached_property
    def session(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("session_id"),
            F.col("turn"),
            F.col("role"),
            F.col("text"),
            F.concat_ws(": ", "role", "text").alias("line"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")).alias("day"),
        )
