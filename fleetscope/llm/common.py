"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the ASCII white space that bytes.split() knows.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, set as the checkpoint folder too.

    A local master without one gets a temporary folder; on a cluster that is an error, as
    executors would not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of maximal runs without white space, 0 for null."""
    body = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    count = F.when(body == "", 0).otherwise(F.size(F.split(body, f"[{SPACE}]+")))
    return F.coalesce(count, F.lit(0)).cast("long")


def map_rows(
    df: DataFrame, make: Callable[[Iterable[list]], Iterable[tuple]], schema: str
) -> DataFrame:
    """Rows that make() yields from the rows (lists of values) of a task, as Arrow batches.

    make() must be given as a module function or a partial of one. Batches are cut by the
    volume of what they hold, so that long texts do not add up in memory.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, kinds.get(f.dataType.simpleString()) or _nested(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        volume = 0
        for row in make(rows()):
            held.append(row)
            volume += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if volume > 4_000_000:
                yield _batch(held, arrow)
                held, volume = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _nested(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def with_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """df with 0-based positions in the total order, without a one-task sort.

    A range-partitioned sort numbers rows within partitions; the first position of each
    partition follows from one row count per partition.
    """
    numbered = checkpointed(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = numbered.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts: dict[int, int] = {}
    total = 0
    for row in counts:
        starts[row["part"]] = total
        total += row["count"]
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    if not starts:
        return numbered.withColumn(rank, inside).drop("_place")
    table = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    return numbered.withColumn(rank, table[part] + inside).drop("_place")


def smallest_of_component(links: DataFrame) -> DataFrame:
    """(node, root): each node of links (a, b) with the smallest node it is connected to.

    Alternating large-star and small-star rounds; each round is a hash aggregate and one
    join on the node, checkpointed. Nodes without links are not returned.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = edges.distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = (
            edges.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
        )
        edges = checkpointed(edges.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Rows of a side table up to which it is sent to every executor.
SMALL_ROWS = 200_000


def join_side(df: DataFrame, side: DataFrame, on, how: str = "inner") -> DataFrame:
    """df joined with side, whose rows were checkpointed; the size of side is counted first.

    Up to SMALL_ROWS short rows are broadcast; beyond that Spark shuffles both sides and
    splits the partitions of a hot key.
    """
    return df.join(F.broadcast(side) if side.count() <= SMALL_ROWS else side, on, how)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
