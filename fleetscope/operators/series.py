"""Ordered per-key operations whose work does not sit in one task per key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task, and one
connection may hold a third of all rows.  Every function here splits a key into
slices (of time, or of any other monotone value), works inside the slices, and
carries a one-row summary per slice across slice borders.  The summaries are
built with map-side combine, so only they ever meet per key.  Results are exact.

The ``with_*`` functions use slices of a fixed width of time.  ``with_slices`` and ``scan`` size
them by the data: a block of time with more than SLICE_ROWS rows is cut finer, so a key
whose rows all fall into one hour still spreads; rows are dealt to their slice once, and any
number of columns is carried by one summary row per slice.  Planning them costs a counting pass, so on
small inputs a single column is cheaper by a fixed width.

Keys must be non-null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
SLICE = "_slice"
LEAST = -(2**63)
#: Rows of a block of time from which it is cut into narrower slices.
SLICE_ROWS = 1_000_000
#: Parts a block may be cut into; a block of a day or an hour is a whole multiple of each part.
PARTS = (2, 4, 8, 24, 48, 96, 240, 480, 1_440, 2_880, 7_200, 14_400, 28_800, 72_000, 144_000, 720_000, 3_600_000)


def time_slice(ts: str | Column, width: int = HOUR_MS) -> Column:
    return F.floor((F.col(ts) if isinstance(ts, str) else ts) / F.lit(width))


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    width: int = HOUR_MS,
    slice_by: Column | None = None,
) -> DataFrame:
    """``lag(src)`` per key as ``out`` for each ``{out: src}``; the first order column is the time."""
    sliced = df.withColumn(SLICE, slice_by if slice_by is not None else time_slice(order[0], width))
    payload = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    tails = sliced.groupBy(*keys, SLICE).agg(F.max_by(payload, F.struct(*order)).alias("__tail"))
    borders = tails.select(
        *keys, SLICE, F.lag("__tail").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("__carry")
    )
    inside = _ordered(keys, order)
    return (
        sliced.withColumn("__rn", F.row_number().over(inside))
        .withColumn("__prev", F.lag(payload).over(inside))
        .join(borders, [*keys, SLICE], "left")
        .withColumn("__prev", F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__prev")))
        .withColumns({out: F.col(f"__prev.{out}") for out in columns})
        .drop("__rn", "__prev", "__carry", SLICE)
    )


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str | Column],
    width: int = HOUR_MS,
    slice_by: Column | None = None,
) -> DataFrame:
    """Inclusive running sum per key as ``out`` for each ``{out: src}``."""
    source = {out: F.col(src) if isinstance(src, str) else src for out, src in columns.items()}
    sliced = df.withColumns(
        {SLICE: slice_by if slice_by is not None else time_slice(order[0], width)}
        | {f"_v_{out}": src for out, src in source.items()}
    )
    totals = sliced.groupBy(*keys, SLICE).agg(
        *[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in columns]
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *keys, SLICE, *[F.sum(f"_t_{out}").over(before).alias(f"_b_{out}") for out in columns]
    )
    upto = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumns({f"_i_{out}": F.sum(f"_v_{out}").over(upto) for out in columns})
        .join(prefix, [*keys, SLICE], "left")
        .withColumns(
            {
                out: F.coalesce(f"_i_{out}", F.lit(0)) + F.coalesce(f"_b_{out}", F.lit(0))
                for out in columns
            }
        )
        .drop(SLICE, *[f"_{p}_{out}" for out in columns for p in "vib"])
    )


def with_row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "idx",
    width: int = HOUR_MS,
    slice_by: Column | None = None,
) -> DataFrame:
    """Zero-based position of a row within its key."""
    counted = with_running_sum(df, keys, order, {out: F.lit(1).cast("bigint")}, width, slice_by)
    return counted.withColumn(out, F.col(out) - 1)


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    width: int = HOUR_MS,
    slice_by: Column | None = None,
    before: bool = False,
) -> DataFrame:
    """Last non-null value at or before the row (only before it on request).

    Over the union of two series this is the backward as-of join.
    """
    sliced = df.withColumn(SLICE, slice_by if slice_by is not None else time_slice(order[0], width))
    lasts = sliced.groupBy(*keys, SLICE).agg(
        *[
            F.max_by(src, F.when(F.col(src).isNotNull(), F.struct(*order))).alias(f"_l_{out}")
            for out, src in columns.items()
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *keys,
        SLICE,
        *[F.last(f"_l_{out}", ignorenulls=True).over(earlier).alias(f"_c_{out}") for out in columns],
    )
    upto = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return (
        sliced.withColumns(
            {f"_i_{o}": F.last(src, ignorenulls=True).over(upto) for o, src in columns.items()}
        )
        .join(carried, [*keys, SLICE], "left")
        .withColumns({o: F.coalesce(f"_i_{o}", f"_c_{o}") for o in columns})
        .drop(SLICE, *[f"_{p}_{o}" for o in columns for p in "ic"])
    )


def with_streak(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, out: str, width: int = DAY_MS
) -> DataFrame:
    """Length of the run of rows ending here on which the flag holds (zero where it does not)."""
    slices = [*keys, SLICE]
    sliced = df.withColumn(SLICE, time_slice(order[0], width)).withColumn("__f", F.coalesce(flag, F.lit(False)))
    upto = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.withColumn("__n", F.row_number().over(_ordered(keys, order))).withColumn(
        "__off", F.max(F.when(~F.col("__f"), F.col("__n"))).over(upto)
    )
    # Run at the end of each slice; it goes on through slices on which the flag always holds.
    ends = inside.groupBy(*slices).agg(F.max("__n").alias("__rows"), F.max("__off").alias("__last"))
    breaks = F.sum(F.col("__last").isNotNull().cast("int")).over(Window.partitionBy(*keys).orderBy(SLICE))
    tail = F.col("__rows") - F.coalesce("__last", F.lit(0))
    grown = ends.withColumn("__g", breaks).withColumn("__end", F.sum(tail).over(Window.partitionBy(*keys, "__g").orderBy(SLICE)))
    carried = grown.select(*slices, F.lag("__end").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("__carry"))
    run = F.when(F.col("__off").isNotNull(), F.col("__n") - F.col("__off")).otherwise(
        F.col("__n") + F.coalesce("__carry", F.lit(0))
    )
    return (
        inside.join(carried, slices, "left")
        .withColumn(out, run.cast("bigint"))
        .drop(SLICE, "__f", "__n", "__off", "__carry")
    )


def over_trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    aggregates: Mapping[str, Column],
    width: int = HOUR_MS,
    slice_by: Column | None = None,
) -> DataFrame:
    """Aggregates over the current row and the ``rows - 1`` before it.

    Rows are numbered per key and cut into chunks; the last ``rows - 1`` of each
    chunk are also handed to the next chunk as its halo.
    """
    chunk_rows = max(rows * 8, 50_000)
    indexed = with_row_index(df, keys, order, "_idx", width, slice_by)
    own = F.floor(F.col("_idx") / chunk_rows)
    in_halo = F.col("_idx") % chunk_rows >= chunk_rows - (rows - 1)
    chunked = indexed.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(in_halo, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = (
        Window.partitionBy(*keys, "_chunk").orderBy("_idx").rowsBetween(-(rows - 1), Window.currentRow)
    )
    return (
        chunked.withColumns({out: agg.over(frame) for out, agg in aggregates.items()})
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_idx", "_own", "_chunk")
    )


def with_trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    columns: Mapping[str, Column],
    width: int = HOUR_MS,
) -> DataFrame:
    """Sums over the current row and the ``rows - 1`` before it, for whole-number columns.

    A running sum less the running sum ``rows`` earlier: exact for integers, and its cost does
    not grow with the frame. Chunks hand their last ``rows`` rows on to the next one.
    """
    chunk_rows = max(rows * 8, 50_000)
    indexed = with_row_index(df, keys, order, "_idx", width)
    own = F.floor(F.col("_idx") / chunk_rows)
    in_halo = F.col("_idx") % chunk_rows >= chunk_rows - rows
    chunked = indexed.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(in_halo, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    whole = Window.partitionBy(*keys, "_chunk").orderBy("_idx")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumns({f"_c_{out}": F.sum(value).over(upto) for out, value in columns.items()})
        .withColumns(
            {out: F.col(f"_c_{out}") - F.coalesce(F.lag(f"_c_{out}", rows).over(whole), F.lit(0)) for out in columns}
        )
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_idx", "_own", "_chunk", *[f"_c_{out}" for out in columns])
    )


def over_trailing_range(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    span: int,
    aggregates: Mapping[str, Column],
    inclusive: bool = True,
    until: int = 0,
) -> DataFrame:
    """Aggregates over rows of the key with time in ``[ts - span, ts - until]`` (open at the start if not inclusive).

    Slices are ``span`` wide (at least an hour); rows near the end of a slice are copied to the next.
    """
    width = max(span, HOUR_MS)
    own = F.floor(F.col(ts) / width)
    in_halo = F.col(ts) % width >= width - span
    chunked = df.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(in_halo, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    low = -span if inclusive else -(span - 1)
    frame = Window.partitionBy(*keys, "_chunk").orderBy(ts).rangeBetween(low, -until)
    return (
        chunked.withColumns({out: agg.over(frame) for out, agg in aggregates.items()})
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_own", "_chunk")
    )


def with_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int = DAY_MS) -> DataFrame:
    """df with the start of each row's slice as SLICE, dealt out by key and slice.

    Slices are ``width`` wide, but a block of that width with more than SLICE_ROWS rows is cut so that its
    densest part of a 1,440th falls into pieces of SLICE_ROWS. There is at most one such block
    per SLICE_ROWS rows, so the list of them is broadcast: a millionth of the input's rows.
    """
    ts, fine = F.col(order[0]), max(1, width // 1_440)
    block = F.floor(ts / F.lit(width)) * F.lit(width)
    parts = df.groupBy(*keys, block.alias("__block"), F.floor(ts / F.lit(fine)).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    blocks = parts.groupBy(*keys, "__block").agg(F.sum("__n").alias("__n"), F.max("__n").alias("__most"))
    pieces = F.col("__most") * (width / fine) / SLICE_ROWS
    cuts = [p for p in PARTS if width % p == 0]
    narrow = F.lit(width // cuts[-1]) if cuts else F.lit(width)
    for p in reversed(cuts):
        narrow = F.when(pieces <= p, width // p).otherwise(narrow)
    busy = blocks.where(F.col("__n") > SLICE_ROWS).select(*keys, "__block", narrow.alias("__width"))
    cut = df.withColumn("__block", block).join(F.broadcast(busy), [*keys, "__block"], "left")
    own = F.coalesce("__width", F.lit(width))
    return _dealt(cut.withColumn(SLICE, F.floor(ts / own) * own).drop("__block", "__width"), keys)


def _dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df by key and slice; rows without a time come first. Nothing here may be null, or joins would filter one side more."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.withColumn(SLICE, F.coalesce(SLICE, F.lit(LEAST))).repartition(*keys, SLICE)


class Carry(NamedTuple):
    """One column of a scan; see previous(), last_known(), running_sum() and streak()."""

    kind: str
    of: Column


def previous(of: str | Column) -> Carry:
    """The value of the row before."""
    return Carry("previous", _column(of))


def last_known(of: str | Column, before: bool = False) -> Carry:
    """The last value that is not null, up to this row or only before it."""
    return Carry("before" if before else "known", _column(of))


def running_sum(of: str | Column) -> Carry:
    """The sum up to this row."""
    return Carry("sum", _column(of))


def streak(flag: str | Column) -> Carry:
    """The length of the run of rows ending here on which flag holds, 0 where it does not."""
    return Carry("streak", F.coalesce(_column(flag), F.lit(False)))


def _column(of: str | Column) -> Column:
    return F.col(of) if isinstance(of, str) else of


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    wanted: Mapping[str, Carry],
    width: int = DAY_MS,
    slice_by: Column | None = None,
) -> DataFrame:
    """df with the wanted columns, each over all earlier rows of the key; the first of ``order`` is the time.

    Rows that have their slice already keep it; otherwise ``with_slices`` cuts them, or ``slice_by``,
    which must not fall along the order. SLICE stays in the result for the next scan.
    """
    if SLICE not in df.columns:
        df = with_slices(df, keys, order, width) if slice_by is None else _dealt(df.withColumn(SLICE, slice_by.cast("bigint")), keys)
    row = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto, earlier = (row.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    slices = Window.partitionBy(*keys).orderBy(SLICE)
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    own: dict[str, Column] = {"__n": F.row_number().over(row), "__end": F.lead(F.lit(True)).over(row).isNull()}
    runs: dict[str, Column] = {}  # over row numbers, so a step later
    ends: dict[str, Column] = {}
    carried: dict[str, Column] = {}
    found: dict[str, Column] = {}
    for name, (kind, _) in wanted.items():
        v, i, e, c = (f"__{x}_{name}" for x in "viec")
        if kind == "previous":
            own[i], ends[e], carried[c] = F.lag(v).over(row), F.col(v), F.lag(e).over(slices)
            found[name] = F.when(F.col("__n") == 1, F.col(c)).otherwise(F.col(i))
        elif kind == "sum":
            own[i], ends[e], carried[c] = F.sum(v).over(upto), F.col(i), F.sum(e).over(before)
            found[name] = F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif kind == "streak":
            runs[i] = F.max(F.when(~F.col(v), F.col("__n"))).over(upto)  # the last row without the flag
            length = F.col("__n") - F.coalesce(i, F.lit(0))
            # the run at a slice's end: all rows since the last slice with a break, and that one's tail
            ends[e] = F.struct(length.cast("bigint").alias("n"), F.col(i).isNotNull().alias("broken"))
            lost = F.last(F.when(F.col(f"{e}.broken"), F.col(f"{c}_old")), ignorenulls=True).over(before)
            carried[c] = F.col(f"{c}_old") - F.coalesce(lost, F.lit(0))
            found[name] = F.when(F.col(i).isNotNull(), length).otherwise(F.col("__n") + F.coalesce(c, F.lit(0))).cast("bigint")
        else:
            own[i] = F.last(v, ignorenulls=True).over(upto if kind == "known" else earlier)
            ends[e] = F.coalesce(v, i)
            carried[c] = F.last(e, ignorenulls=True).over(before)
            found[name] = F.coalesce(i, c)
    inside = df.withColumns({f"__v_{name}": c.of for name, c in wanted.items()}).withColumns(own).withColumns(runs)
    # The condition on all columns holds always. It keeps them from being pruned here, so that both sides of the
    # join below read the same shuffled rows and Spark moves them once.
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if dict(df.dtypes)[c].find("map<") < 0]) >= F.lit(LEAST)
    last = inside.where(F.col("__end") & whole).select(*keys, SLICE, *[value.alias(e) for e, value in ends.items()])
    old = {f"__c_{n}_old": F.coalesce(F.sum(f"__e_{n}.n").over(before), F.lit(0)) for n, c in wanted.items() if c.kind == "streak"}
    border = last.withColumns(old).select(*keys, SLICE, *[value.alias(c) for c, value in carried.items()])
    joined = inside.join(border, [*keys, SLICE], "left").withColumns(found)
    return joined.drop("__n", "__end", *[f"__{x}_{name}" for name in wanted for x in "vi"], *carried)
