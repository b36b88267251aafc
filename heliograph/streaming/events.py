"""Event-time operators that work on batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def latest_wins(rows: DataFrame, key: str, generation: Column, value: Column) -> DataFrame:
    """Per key the value of the highest generation: older answers never show after newer ones."""
    return rows.groupBy(key).agg(F.max(generation).alias("generation"), F.max_by(value, generation).alias("value"))


def debounced(rows: DataFrame, key: str, ts: str, gap: str, value: Column, late: str | None = None) -> DataFrame:
    """The last value of every burst: events of a key closer than gap are one; it fires once the gap is quiet.

    late: the watermark of a stream.
    """
    source = rows.withWatermark(ts, late) if late else rows
    w = F.session_window(ts, gap)
    out = source.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max_by(value, F.struct(ts)).alias("value"), F.max(ts).alias("last"))
    return out.select(key, F.col("w.start").alias("start"), "last", "n", "value")


class _Throttle(StatefulProcessor):
    """A key's interval: when it began, and the last value in it.  A timer of event time ends it, so the last value comes out also where the key falls silent."""

    def __init__(self, ts: str, value: str, interval_ms: int) -> None:
        self.ts, self.value, self.interval_ms = ts, value, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, held string")

    def _row(self, key: tuple, end: int, held: str | None) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "fired_ms": [end], "value": [held]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, held = self.open.get() if self.open.exists() else (None, None)
        before = start
        events = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        for t, v in zip(events[self.ts].astype("datetime64[ms]").astype("int64"), events[self.value], strict=True):
            if start is not None and t >= start + self.interval_ms:
                yield self._row(key, start + self.interval_ms, held)
                start = None
            if start is None:
                start = int(t)
            held = None if v is None else str(v)
        if start != before:
            if before is not None:
                self.handle.deleteTimer(before + self.interval_ms)
            self.handle.registerTimer(start + self.interval_ms)
        self.open.update((start, held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, held = self.open.get()
        self.open.clear()
        yield self._row(key, start + self.interval_ms, held)

    def close(self) -> None:
        pass


def throttled(rows: DataFrame, key: str, ts: str, value: str, interval_ms: int, late: str = "0 seconds") -> DataFrame:
    """A stream's leading schedule: an event starts an interval unless one is under way, and the last value in it comes out at its end.

    key, fired_ms, value; a key may be of any type.  An interval ends with a later event of its key or, where
    none comes, once the stream's watermark (late behind the newest event of all keys) is past its end.
    """
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("fired_ms", T.LongType()), T.StructField("value", T.StringType())])
    source = rows.withWatermark(ts, late).groupBy(key)
    return source.transformWithStateInPandas(_Throttle(ts, value, interval_ms), schema, "append", "eventTime")


#: a view is refreshed after so many changes and so many seconds since the last refresh (fixed values)
REFRESH_CHANGES, REFRESH_MS = 512, 2000


class _Refresh(StatefulProcessor):
    """Counts changes since the last refresh, and knows when that was."""

    def __init__(self, ts: str, changes: int, milliseconds: int) -> None:
        self.ts, self.changes, self.milliseconds = ts, changes, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "n long, at long, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, at, total = self.since.get() if self.since.exists() else (0, None, 0)
        events = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        fired = []
        for t in events[self.ts].astype("datetime64[ms]").astype("int64"):
            at = int(t) if at is None else at
            n, total = n + 1, total + 1
            if n >= self.changes and t - at >= self.milliseconds:
                fired.append((key[0], int(t), total))
                n, at = 0, int(t)
        self.since.update((n, at, total))
        yield pd.DataFrame(fired, columns=["key", "at_ms", "changed"])

    def close(self) -> None:
        pass


def refreshes(rows: DataFrame, key: str, ts: str, changes: int = REFRESH_CHANGES, milliseconds: int = REFRESH_MS) -> DataFrame:
    """When a view is refreshed while a stream of changes goes on: key, at_ms and the number of changes so far.

    Both must have come since the last refresh (or the first change): enough changes and enough time.
    """
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("at_ms", T.LongType()), T.StructField("changed", T.LongType())])
    return rows.groupBy(key).transformWithStateInPandas(_Refresh(ts, changes, milliseconds), schema, "append", "none")


def progress(rows: DataFrame, every: int) -> DataFrame:
    """Rows after which a view is refreshed: each ``every`` changes."""
    return rows.filter(F.col("changed") % every == 0)
