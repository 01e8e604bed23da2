"""Streams that need timers: request windows that start with a client's first request, and sources without a success for too long.

State is one value a key; a timer in event time ends it when nothing more arrives, so a key that has gone
quiet keeps no state. The overdue sources have a batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Windows(StatefulProcessor):
    """A client's open window: its start and requests so far."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "start_ms long, requests long")

    def _rows(self, key, closed: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"client": pd.Series([key[0]] * len(closed), dtype=object), "start_ms": [s for s, _ in closed], "requests": [n for _, n in closed]}).astype({"start_ms": "int64", "requests": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(x) for df in rows for x in df["at_ms"])
        start, n = self.open.get() if self.open.exists() else (None, 0)
        closed = []
        for at in times:
            if start is None or at >= start + self.window_ms:
                if start is not None:
                    closed.append((start, n))
                start, n = at, 0
            n += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update((start, n))
        self.handle.registerTimer(start + self.window_ms)
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = [tuple(self.open.get())] if self.open.exists() else []
        self.open.clear()
        yield self._rows(key, closed)

    def close(self) -> None:
        pass


class _Overdue(StatefulProcessor):
    """A source's last success; its timer is due when the next one is late."""

    def __init__(self, allowed_ms: int):
        self.allowed_ms = allowed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at_ms long")

    def _rows(self, key, late: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"source": pd.Series([key[0]] * len(late), dtype=object), "since_ms": late, "due_ms": [x + self.allowed_ms for x in late]}).astype({"since_ms": "int64", "due_ms": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(x) for df in rows for x in df["at_ms"])
        before = [self.last.get()[0]] if self.last.exists() else []
        seen = before + [t for t in times if not before or t > before[0]]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((seen[-1],))
        self.handle.registerTimer(seen[-1] + self.allowed_ms)
        yield self._rows(key, [a for a, b in zip(seen, seen[1:]) if b > a + self.allowed_ms])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        late = [self.last.get()[0]] if self.last.exists() else []
        self.last.clear()
        yield self._rows(key, late)

    def close(self) -> None:
        pass


def _in_ms(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at")).where("key is not null and at is not null")
    return rows.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))


def request_windows(requests: DataFrame, limit: int = 120, seconds: int = 60, client: str = "client", at: str = "ts", delay: str = "5 minutes") -> DataFrame:
    """STR-4, exact: client, start, requests, limited: windows that start with a client's first request after the last one's end.

    A stream closes a window when a request comes behind it, or by a timer when the watermark, `delay`
    behind the last event, has passed its end. Requests within a micro-batch are taken in order of time.
    Needs the RocksDB state store. Requests without a client or time are passed over.
    """
    out = _in_ms(requests, client, at, delay).groupBy("key").transformWithStateInPandas(_Windows(seconds * 1000), "client string, start_ms long, requests long", "Append", "EventTime")
    return out.select("client", F.timestamp_millis("start_ms").alias("start"), "requests", (F.col("requests") > limit).alias("limited"))


def overdue_sources(successes: DataFrame, hours: int = 26, source: str = "source_id", at: str = "at", delay: str = "1 hour") -> DataFrame:
    """STR-2, no success: source, since, due: each success after which no other came within the hours, also if nothing arrives any more. Needs the RocksDB state store."""
    out = _in_ms(successes, source, at, delay).groupBy("key").transformWithStateInPandas(_Overdue(hours * 3_600_000), "source string, since_ms long, due_ms long", "Append", "EventTime")
    return out.select("source", F.timestamp_millis("since_ms").alias("since"), F.timestamp_millis("due_ms").alias("due"))


def overdue_gaps(successes: DataFrame, now, hours: int = 26, source: str = "source_id", at: str = "at") -> DataFrame:
    """STR-2's batch twin: gaps between a source's successes of more than the hours, the last one up to now."""
    later = F.lead(at).over(Window.partitionBy(source).orderBy(at))
    due = F.col(at) + F.expr(f"interval {hours} hours")
    gaps = successes.select(source, at).distinct().withColumn("next", later).withColumn("due", due)
    return gaps.where((F.col("next") > F.col("due")) | (F.col("next").isNull() & (F.col("due") <= now))).select(F.col(source).cast("string").alias("source"), F.col(at).alias("since"), "due")
