"""Detectors on live polls: typed state per key, event-time timers and a watermark.

A ``Live`` names the keys of a detector, the columns it reads, its typed state, its output and
its step. Rows wait in a list state until the watermark has passed them; then a timer runs
them through the step in event-time order. So rows may arrive in any order within the
allowed lateness, over any number of restarts of one checkpoint, and the result is that of one pass
over history. What Spark drops as later than the watermark belongs into a side table
(``wiring.split_late``).

A key that is silent for ``quiet_ms`` of event time loses its state; its next row starts anew.
Held at any time: per key one state, and the rows younger than the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Row as SparkRow
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetscope.streaming.runner import _columns

DAY_MS = 86_400_000
#: Rows handed to the state at once.
LOT = 1_000
#: Timers and several state variables need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Live(NamedTuple):
    """A detector over a stream; every row has ``ts_ms``.

    ``step(state, row)`` changes a dict of the state's fields (absent ones are null) and yields
    output tuples. With ``gather`` it gets the list of all rows of one time, ordered by ``order``.
    """

    keys: tuple[str, ...]
    reads: tuple[str, ...]
    state: str
    out: str
    step: Callable[[dict, Any], Iterable[tuple]]
    order: tuple[str, ...] = ("ts_ms", "id")
    gather: bool = False
    quiet_ms: int = DAY_MS
    #: Time after which an open group of the state is whole; ``close`` then empties it and yields output tuples.
    due: Callable[[dict], int | None] | None = None
    close: Callable[[dict], Iterable[tuple]] | None = None


def _plain(value):
    """Rows of nested state as dicts and lists."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    elif isinstance(value, tuple) and hasattr(value, "_fields"):
        value = dict(zip(value._fields, value, strict=True))
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and value.ndim else value


class Processor(StatefulProcessor):
    """Runs one Live; see the module."""

    def __init__(self, live: Live, row_schema: str, fields: list[str]):
        self.live, self.row_schema, self.fields = live, row_schema, fields
        self.names = [*live.keys, *_columns(live.out)]
        self.positions = [live.reads.index(c) for c in live.order]
        self.at = live.reads.index("ts_ms")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.live.state)
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.seen = handle.getValueState("seen", "last_ms bigint, due_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[SparkRow]:
        first = None
        while held := [tuple(r[c] for c in self.live.reads) for r in islice(rows, LOT)]:
            self.waiting.appendList(held)
            earliest = min(r[self.at] for r in held)
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        """One timer per key: at the earliest time that something is due."""
        last, due = self.seen.get() if self.seen.exists() else (None, None)
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.seen.update((last, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[SparkRow]:
        now = timerValues.getCurrentWatermarkInMs()
        at = self.at
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ripe, later = [r for r in rows if r[at] <= now], [r for r in rows if r[at] > now]
        last = self.seen.get()[0] if self.seen.exists() else None
        emitted: list[tuple] = []
        state = self._load() if ripe or self.live.due else {}
        if ripe:
            ripe.sort(key=lambda r: tuple((r[p] is None, r[p]) for p in self.positions))
            for row in self._steps(ripe, at):
                seen = row[0].ts_ms if self.live.gather else row.ts_ms
                emitted.extend((*key, *event) for event in self._closed(state, seen - 1))
                if last is not None and seen - last >= self.live.quiet_ms:
                    state = {}
                last = seen
                emitted.extend((*key, *event) for event in self.live.step(state, row))
        emitted.extend((*key, *event) for event in self._closed(state, now))
        if ripe or self.live.due:
            self._store(state)
        if ripe:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        due = min((r[at] for r in later), default=None)
        whole = self.live.due(state) if self.live.due else None
        if whole is not None:
            due = whole if due is None else min(due, whole)
        if last is not None:
            over = last + self.live.quiet_ms
            if due is None and over <= now:
                self.state.clear()
                self.seen.clear()
                self.waiting.clear()
            else:
                due = over if due is None else min(due, over) if over > now else due
                self.handle.registerTimer(due)
                self.seen.update((last, due))
        elif due is not None:
            self.handle.registerTimer(due)
            self.seen.update((None, due))
        yield from (SparkRow(**dict(zip(self.names, e, strict=True))) for e in emitted)

    def _closed(self, state: dict, upto: int) -> Iterator[tuple]:
        """Output of the group whose last moment is not after ``upto``."""
        whole = self.live.due(state) if self.live.due else None
        if whole is not None and whole <= upto:
            yield from self.live.close(state)

    def _steps(self, ripe: list[tuple], at: int) -> Iterator[Any]:
        named = [Row(self.live.reads, r) for r in ripe]
        if not self.live.gather:
            yield from named
            return
        start = 0
        for end in range(1, len(named) + 1):
            if end == len(named) or ripe[end][at] != ripe[start][at]:
                yield named[start:end]
                start = end

    def _load(self) -> dict:
        if not self.state.exists():
            return {}
        return {k: _plain(v) for k, v in zip(self.fields, self.state.get(), strict=True) if v is not None}

    def _store(self, state: dict) -> None:
        if state:
            self.state.update(tuple(state.get(f) for f in self.fields))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


class Row:
    """Columns of a row as attributes."""

    def __init__(self, names: tuple[str, ...], values: tuple):
        self.__dict__.update(zip(names, values, strict=True))


def live(stream: DataFrame, detector: Live, lateness: str = "10 minutes") -> DataFrame:
    """The keys of the detector and its output over a stream; rows may come ``lateness`` out of order.

    Rows without ``ts_ms`` or with a null key have no place in a series and are left out.
    """
    use_store(stream.sparkSession)
    kinds = dict(stream.dtypes)
    row_schema = ", ".join(f"{c} {kinds[c]}" for c in detector.reads)
    out = ", ".join([*(f"{k} {kinds[k]}" for k in detector.keys), detector.out])
    fields = stream.sparkSession.createDataFrame([], detector.state).columns
    known = stream.dropna(subset=["ts_ms", *detector.keys])
    columns = list(dict.fromkeys([*detector.keys, *detector.reads]))
    timed = known.select(*columns, F.timestamp_millis("ts_ms").alias("event_time")).withWatermark("event_time", lateness)
    return timed.groupBy(*detector.keys).transformWithState(
        Processor(detector, row_schema, fields), outputStructType=out, outputMode="append", timeMode="eventTime"
    )


def use_store(spark: SparkSession) -> None:
    if spark.conf.get(*STORE[:1]) != STORE[1]:
        spark.conf.set(*STORE)
