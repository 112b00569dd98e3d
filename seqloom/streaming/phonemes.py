"""A buffer of notes on a stream: each is released a little ahead of its start, dropped if it comes too late, evicted if too many wait.

Rows are (key, id, time, kind, start, end, number, value): ``note`` with its start and end, ``control`` with its number and value; times are whole
milliseconds. What happens depends on event time alone: rows wait until the watermark passes them and are then taken in the order of (time, id),
so neither micro-batches nor restarts change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LOOKAHEAD_MS, GRACE_MS, CAPACITY = 100, 1000, 16
#: The store whose state can hold lists, maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVAL = "at long, id long, kind string, start long, end long, number int, value double"
WAITING = "at long, id long, start long, numbers array<int>, levels array<double>"


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in STORE."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Buffer(StatefulProcessor):
    """State of one key: arrivals that the watermark has not passed (a list), notes that wait for their start (a list of at most ``capacity``),
    the latest value of each control (a map), the time of the one timer that is set (a value)."""

    def __init__(self, lookahead: int, grace: int, capacity: int):
        self.lookahead, self.grace, self.capacity = lookahead, grace, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrivals = handle.getListState("arrivals", ARRIVAL)
        self.notes = handle.getListState("notes", WAITING)
        self.controls = handle.getMapState("controls", "number int", "value double")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None) -> None:
        """One timer, at the earliest time that something is due."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is not None and now != at:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if at is not None and now != at:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self.timer.get()[0] if self.timer.exists() else None
        for part in rows:
            part = part[["at", "id", "kind", "start", "end", "number", "value"]]
            new = [tuple(None if pd.isna(v) else kind(v) for v, kind in zip(r, (int, int, str, int, int, int, float), strict=True)) for r in part.itertuples(index=False)]
            self.arrivals.appendList(new)
            due = min([*(r[0] for r in new), *([due] if due is not None else [])])
        self._wake(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        waiting = [(a, i, s, dict(zip(n, v, strict=True))) for a, i, s, n, v in self.notes.get()] if self.notes.exists() else []
        levels = {n[0]: v[0] for n, v in self.controls.iterator()} if self.controls.exists() else {}
        rows = sorted(self.arrivals.get(), key=lambda r: (r[0], r[1], str(r))) if self.arrivals.exists() else []
        out: list[tuple] = []

        def release(until: int) -> None:
            due = lambda w: max(w[0], w[2] - self.lookahead)
            for w in sorted((w for w in waiting if due(w) <= until), key=lambda w: (due(w), w[:2])):
                out.append((w[1], "played", due(w), w[3]))
            waiting[:] = [w for w in waiting if due(w) > until]

        passed = [r for r in rows if r[0] <= now]
        for at, i, kind, start, end, number, value in passed:
            release(at)
            if kind == "control":
                levels[number] = value
            elif kind == "note" and end < at - self.grace:
                out.append((i, "late", at, dict(levels)))
            elif kind == "note":
                waiting.append((at, i, start, dict(levels)))
                release(at)
                if len(waiting) > self.capacity:
                    _, first, _, then = waiting.pop(0)
                    out.append((first, "evicted", at, then))
        release(now)
        left = [r for r in rows if r[0] > now]
        for state, values in ((self.arrivals, left), (self.notes, [(a, i, s, list(c), list(c.values())) for a, i, s, c in waiting])):
            if values:
                state.put(values)
            else:
                state.clear()
        for number, value in levels.items():
            self.controls.updateValue((number,), (value,))
        due = [r[0] for r in left] + [max(a, s - self.lookahead) for a, _, s, _ in waiting]
        self._wake(min(due) if due else None)
        if out:
            frame = pd.DataFrame(out, columns=["id", "status", "at", "controls"])
            frame.insert(0, "key", key[0])
            frame["controls"] = [[{"number": n, "value": v} for n, v in sorted(c.items())] for c in frame["controls"]]
            yield frame

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, delay: str = "0 seconds", lookahead: int = LOOKAHEAD_MS, grace: int = GRACE_MS, capacity: int = CAPACITY) -> DataFrame:
    """(key, id, status, at, controls) of each note of a stream: ``played`` ahead of its start, ``late`` where it had ended long before it came, ``evicted``
    by a newer one while more than ``capacity`` waited; ``controls`` are the latest values by number when it came. Nothing is dropped unsaid, but
    rows no newer than the watermark (1970 at first), which Spark drops. Notes that still wait stay in the state. Start it inside ``store``."""
    kind = dict(rows.dtypes)["key"]
    x = rows.withColumn("ts", F.timestamp_millis("time")).withWatermark("ts", delay).select("key", F.col("time").alias("at"), "id", "kind", "start", "end", "number", "value", "ts")
    out = f"key {kind}, id long, status string, at long, controls array<struct<number:int,value:double>>"
    return x.groupBy("key").transformWithStateInPandas(Buffer(lookahead, grace, capacity), out, "append", "eventTime")
