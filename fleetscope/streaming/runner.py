"""One fold, two runs: over stored history and over a stream.

A fold is ``step(state, row)``: it changes the ``state`` dict (JSON types only) and
yields output tuples. History runs read the rows of a key in order through
``mapInPandas`` on explicitly sorted partitions, so memory holds one Arrow batch,
not a key. Where the caller can name rows after which the state is the initial one
(``reset``), a key is cut there into independent segments and those rows are
dropped, so a busy connection spreads over many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.operators.series import DAY_MS, with_previous, with_running_sum

Step = Callable[[dict, Any], Iterable[tuple]]


def _python(value):
    return value.item() if isinstance(value, np.generic) else value


def _clean(row):
    """Row with pandas scalars as Python values and missing numbers as None."""
    return type(row)(*[None if isinstance(v, float) and v != v else _python(v) for v in row])


def _columns(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def fold_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    out: str,
    reset: Column | None = None,
    closes: Column | None = None,
    slice_ms: int = DAY_MS,
    forgets_ms: int | None = None,
) -> DataFrame:
    """Run a fold over all rows of each key in order; ``out`` names the emitted columns with types.

    ``reset`` rows leave the initial state and emit nothing: they only cut. ``closes`` rows leave the
    initial state but may emit: they end their segment, and one that follows another is dropped.
    ``forgets_ms``: a row more than this behind the one before it (by the first of ``order``) is treated
    as the first of its key by ``step``, so a new segment starts there.
    """
    keys = list(keys)
    groups = keys
    if forgets_ms is not None:
        # Rows further apart than a slot is wide lie in two slots, so a pause ends with the first row of a slot.
        slot, time = F.floor(F.col(order[0]) / forgets_ms).alias("_slot"), F.col(order[0])
        spans = df.groupBy(*keys, slot).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
        along = Window.partitionBy(*keys).orderBy("_slot")
        fresh = F.coalesce(F.col("_first") - F.lag("_last").over(along) > forgets_ms, F.lit(True)).cast("bigint")
        pauses = spans.withColumn("_fresh", fresh).select(*keys, "_slot", F.sum("_fresh").over(along).alias("_pause"))
        df = df.withColumn("_slot", slot).join(pauses, [*keys, "_slot"], "left").drop("_slot")
        groups = [*keys, "_pause"]
    if closes is not None:
        marked = df.withColumn("_closes", F.coalesce(closes, F.lit(False)))
        seen = with_previous(marked, keys, order, {"_after": "_closes"}, slice_ms)
        kept = seen.where(~(F.col("_closes") & F.coalesce("_after", F.lit(True))))
        ended = with_running_sum(kept, keys, order, {"_seg": F.col("_closes").cast("bigint")}, slice_ms)
        df = ended.withColumn("_seg", F.col("_seg") - F.col("_closes").cast("bigint")).drop("_closes", "_after")
        groups = [*groups, "_seg"]
    if reset is not None:
        marked = df.withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("bigint"))
        df = with_running_sum(marked, keys, order, {"_seg": "_reset"}, slice_ms).where(F.col("_reset") == 0).drop("_reset")
        groups = [*groups, "_seg"]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [out])
    names = [*keys, *_columns(out)]
    ordered = df.repartition(*groups).sortWithinPartitions(*groups, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: dict = {}
        for batch in batches:
            emitted: list[tuple] = []
            group_values = zip(*[batch[g] for g in groups])
            for group, raw in zip(group_values, batch.itertuples(index=False, name="Row")):
                if group != current:
                    current, state = group, {}
                row = _clean(raw)
                emitted.extend((*group[: len(keys)], *event) for event in step(state, row))
            if emitted:
                yield pd.DataFrame(emitted, columns=names)

    return ordered.mapInPandas(run, schema)


def fold_stream(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out: str
) -> DataFrame:
    """Run the same fold with checkpointed state per key; rows of a micro-batch are ordered per key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    keys, order = list(keys), list(order)
    kinds = dict(stream.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [out])
    names = [*keys, *_columns(out)]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        emitted = [
            (*[_python(k) for k in key], *event)
            for raw in rows.itertuples(index=False, name="Row")
            for event in step(state, _clean(raw))
        ]
        held.update((json.dumps(state),))
        if emitted:
            yield pd.DataFrame(emitted, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(
        run, schema, "state string", "append", GroupStateTimeout.NoTimeout
    )
