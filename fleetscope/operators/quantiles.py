"""Exact order statistics that stay spread over many tasks.

``percentile`` and ``median`` hold every distinct value of a group in one task.
Here values are first counted per (group, value) with map-side combine, cut into
logarithmic value slices, and ranked inside the slices; only the slice totals
meet per group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Quantile(NamedTuple):
    """``flavour``: nearest = ceil(p*n)-1, floor = floor(p*n), linear = interpolated on (n-1)*p."""

    name: str
    flavour: str
    p: float


def _slice_of(value: Column) -> Column:
    """Order-preserving logarithmic slice number (128 per octave)."""
    magnitude = F.floor(F.log2(F.abs(value.cast("double")) + 1.0) * 128.0)
    return F.when(value < 0, -magnitude - 1).otherwise(magnitude)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[Quantile]
) -> DataFrame:
    """One row per key with ``n`` and one column per wanted quantile; null values are left out."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_slice", _slice_of(F.col("_v")))
    )
    totals = counts.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_sc"))
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    prefix = totals.select(
        *keys,
        "_slice",
        (F.sum("_sc").over(running) - F.col("_sc")).alias("_before"),
        F.sum("_sc").over(whole).alias("_n"),
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = (
        counts.join(prefix, [*keys, "_slice"])
        .withColumn("_hi", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    n = F.col("_n")

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= index) & (index < F.col("_hi")), F.col("_v")))

    aggregates: list[Column] = []
    finals: list[Column] = []
    for q in wanted:
        if q.flavour == "linear":
            position = (n - 1).cast("double") * F.lit(q.p)
            low = F.floor(position)
            aggregates += [
                at(low).cast("double").alias(f"_a_{q.name}"),
                at(F.least(low + 1, n - 1)).cast("double").alias(f"_b_{q.name}"),
            ]
            position = (F.col("n") - 1).cast("double") * F.lit(q.p)
            a, b = F.col(f"_a_{q.name}"), F.col(f"_b_{q.name}")
            finals.append((a + (b - a) * (position - F.floor(position))).alias(q.name))
            continue
        scaled = n.cast("double") * F.lit(q.p)
        index = F.ceil(scaled) - 1 if q.flavour == "nearest" else F.floor(scaled)
        index = F.greatest(F.lit(0), F.least(index, n - 1))
        aggregates.append(at(index).alias(f"_a_{q.name}"))
        finals.append(F.col(f"_a_{q.name}").alias(q.name))
    return ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *aggregates).select(*keys, "n", *finals)


class _Ordered:
    """Values in order, in blocks of bounded length, so that adding, removing and picking one stay cheap."""

    BLOCK = 512

    def __init__(self):
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.size = 0

    def add(self, value: float) -> None:
        self.size += 1
        at = min(bisect_left(self.tops, value), len(self.tops) - 1)
        if at < 0:
            self.blocks, self.tops = [[value]], [value]
            return
        block = self.blocks[at]
        insort(block, value)
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.tops[at : at + 1] = [block[half - 1], block[-1]]
        else:
            self.tops[at] = block[-1]

    def remove(self, value: float) -> None:
        self.size -= 1
        at = bisect_left(self.tops, value)
        block = self.blocks[at]
        del block[bisect_left(block, value)]
        if block:
            self.tops[at] = block[-1]
        else:
            del self.blocks[at], self.tops[at]

    def median(self) -> float | None:
        if not self.size:
            return None
        low = self._at((self.size - 1) // 2)
        return low if self.size % 2 else 0.5 * low + 0.5 * self._at(self.size // 2)

    def _at(self, place: int) -> float:
        for block in self.blocks:
            if place < len(block):
                return block[place]
            place -= len(block)
        raise IndexError(place)


def with_trailing_median(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, span: int, until: int, out: str, count: str
) -> DataFrame:
    """Exact median and count of the key's values with time in ``[ts - span, ts - until]``; ``until`` is above 0.

    One pass over each key in order of time: a value enters the ordered window once and leaves it once, so
    the cost does not grow with rows x frame. A key is cut into slices as wide as the span (an hour at least), and
    the rows a later slice looks back on are copied to it; a task holds the values of one window. Null values
    count for nothing, a window without values has no median, rows without a time are left out.
    """
    if until <= 0:
        raise ValueError("until must be above 0: a row would be part of its own window")
    width = max(span, 3_600_000)
    own = F.floor(F.col(ts) / width)
    seen_later = F.pmod(F.col(ts), F.lit(width)) >= width - span
    dealt = (
        df.where(F.col(ts).isNotNull())
        .withColumn("__own", own)
        .withColumn("__slice", F.explode(F.when(seen_later, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("__v", F.nanvl(F.col(value).cast("double"), F.lit(float("inf"))))
    )
    group = [*keys, "__slice"]
    schema = T.StructType([*dealt.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(count, T.LongType())])

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window = None, _Ordered()
        waiting: deque[tuple[int, float]] = deque()
        inside: deque[tuple[int, float]] = deque()
        for batch in batches:
            medians, sizes, kept = [], [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*group, "__own", ts, "__v")]
            for *at, mine, now, x in zip(*columns):
                if at != key:
                    key, window, waiting, inside = at, _Ordered(), deque(), deque()
                while waiting and waiting[0][0] <= now - until:
                    window.add(waiting[0][1])
                    inside.append(waiting.popleft())
                while inside and inside[0][0] < now - span:
                    window.remove(inside.popleft()[1])
                kept.append(mine == at[-1])
                medians.append(window.median() if kept[-1] else None)
                sizes.append(window.size)
                if x is not None:
                    waiting.append((now, x))
            full = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(medians, pa.float64()), pa.array(sizes, pa.int64())], names=[*batch.schema.names, out, count]
            )
            yield full.filter(pa.array(kept, pa.bool_()))

    ordered = dealt.repartition(*group).sortWithinPartitions(*group, ts)
    return ordered.mapInArrow(slide, schema).drop("__own", "__slice", "__v")
