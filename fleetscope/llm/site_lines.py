"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency is the number of the host's pages that hold it
over all pages of the host; lines over the boilerplate ratio are dropped from every page.

Lines travel as 64-bit hashes only. Counting is a hash aggregate with map-side combine, so a
hot host costs no more than others. As each boilerplate line is on more than `ratio` of a
host's pages, a host has fewer than (mean lines of its pages / ratio) of them: the list that
each page is held against is bounded by the shape of pages, not by their number. Texts are
not shuffled while the lists of all hosts together are short (join_side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import SPACE, checkpointed, join_side


def line_hash(line: Column) -> Column:
    """Equal for lines that differ in outer blanks only."""
    return F.xxhash64(F.trim(line, F.lit(" \t\r")))


def with_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACE}]")


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(_host, line, n_pages, host_pages): lines on over ratio of a host's pages.

    line is the hash. A line must be on min_pages pages at least, so that hosts of a few
    pages are left alone.
    """
    pages = docs.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("host_pages"))
    hashes = F.transform(F.filter(F.split("text", "\n", -1), with_word), line_hash)
    lines = docs.select(F.col(host).alias("_host"), F.explode(F.array_distinct(hashes)).alias("line"))
    counts = lines.groupBy("_host", "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    counts, pages = counts.alias("c"), pages.alias("p")
    return (
        counts.join(pages, F.col("c._host").eqNullSafe(F.col("p._host")))
        .where(F.col("n_pages") > ratio * F.col("host_pages"))
        .select("c._host", "line", "n_pages", "host_pages")
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 5
) -> DataFrame:
    """docs with a changed text, and n_lines and n_dropped beside its columns.

    Lines are what stands between newlines; those without a word always stay and do not
    count in n_lines. A null text stays null with 0 lines, a null host is a host of its
    own, repeated rows count as pages of their own, and a page may lose all its lines.
    """
    lists = checkpointed(
        boilerplate(docs, host, ratio, min_pages).groupBy("_host").agg(F.collect_set("line").alias("_lines"))
    )
    joined = join_side(docs, lists, F.col(host).eqNullSafe(F.col("_host")), "left")
    lines = F.split("text", "\n", -1)
    listed = F.coalesce("_lines", F.array().cast("array<bigint>"))
    stays = F.filter(lines, lambda x: ~with_word(x) | ~F.array_contains(listed, line_hash(x)))
    worded = F.size(F.filter(lines, with_word))
    own = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return joined.select(
        *own,
        F.array_join(stays, "\n").alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(worded).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(stays)).cast("long").alias("n_dropped"),
    )
