"""Worker state machines as streams with timers: `transformWithState` on RocksDB.

Events (key, ts, event_id, kind) are held in state until the watermark has passed them and are then taken in the order of
time and event_id, so that results do not depend on how a replay is cut into batches. Timers run on event time: a key wakes
when the watermark reaches its next event or the next thing that is due. A key that has come to rest is forgotten
after `keep`, so state follows the keys in use, not all keys ever seen. Time stamps count in milliseconds.

A machine is a small class: `start` (its state as a tuple), `schema`, `step` (what an event does), `due` (when something will
happen by itself, or None), `fire` (what then happens) and `rests` (whether nothing would be lost by forgetting the state). An event at
the very time at which something is due comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_DDL = "key long, at long, event_id long, what string, n int"
Change = tuple  # at (ms), event_id, what, n
Report = Row("key", "at", "event_id", "what", "n")
CHUNK = 4096  # events that one entry of the waiting list holds


def chunks(events: list[tuple]) -> list[tuple]:
    """Events as entries of the waiting list."""
    return [tuple(map(list, zip(*events[i : i + CHUNK]))) for i in range(0, len(events), CHUNK)]


@dataclass
class Stale:
    """A running task without events for more than `idle` is reported once, when the time is up; `active` keys are exempt."""

    idle: int = 900_000
    active: tuple = ()
    schema = "since long, event_id long, watched boolean"
    start = (0, 0, False)

    def step(self, key, state, ts, event_id, kind) -> tuple[tuple, list[Change]]:
        return (ts, event_id, kind == "running" and key not in self.active), []

    def due(self, state) -> int | None:
        return state[0] + self.idle + 1 if state[2] else None

    def fire(self, state) -> tuple[tuple, list[Change]]:
        return (state[0], state[1], False), [(state[0] + self.idle, state[1], "stale", 0)]

    def rests(self, state) -> bool:
        return not state[2]


@dataclass
class Breaker:
    """`limit` bad events in a row open the breaker; it closes `open_for` after the last opening."""

    bad: str
    limit: int = 2
    open_for: int = 300_000
    schema = "run int, closes long, event_id long"
    start = (0, -1, 0)

    def step(self, key, state, ts, event_id, kind) -> tuple[tuple, list[Change]]:
        run, closes, opened = state
        run = run + 1 if kind == self.bad else 0
        if run == self.limit:
            return (run, ts + self.open_for, event_id), [(ts, event_id, "open", run)]
        return (run, closes, opened), []

    def due(self, state) -> int | None:
        return state[1] + 1 if state[1] >= 0 else None

    def fire(self, state) -> tuple[tuple, list[Change]]:
        run, closes, opened = state
        return (run, -1, opened), [(closes, opened, "closed", 0)]

    def rests(self, state) -> bool:
        return state[0] == 0 and state[1] < 0


@dataclass
class Retry:
    """The retry machine: a failed attempt makes the item pending, and it is due again after `delay` unless it was picked or reset
    before; the failure that uses up `most` attempts is final."""

    most: int = 3
    delay: int = 60_000
    schema = "status string, count int, since long, event_id long"
    start = ("pending", 0, -1, 0)

    def step(self, key, state, ts, event_id, kind) -> tuple[tuple, list[Change]]:
        status, count, since, of = state
        if kind == "reset":
            return ("pending", 0, -1, 0), []
        if kind == "pick" and status == "pending" and count < self.most:
            return ("retrying", count + 1, -1, 0), []
        if kind == "success" and status == "retrying":
            return ("succeeded", count, -1, 0), [(ts, event_id, "succeeded", count)]
        if kind == "fail" and status == "retrying":
            if count >= self.most:
                return ("failed", count, -1, 0), [(ts, event_id, "failed", count)]
            return ("pending", count, ts, event_id), []
        return state, []

    def due(self, state) -> int | None:
        return state[2] + self.delay + 1 if state[2] >= 0 else None

    def fire(self, state) -> tuple[tuple, list[Change]]:
        status, count, since, of = state
        return (status, count, -1, of), [(since + self.delay, of, "due", count)]

    def rests(self, state) -> bool:
        return state[0] in ("succeeded", "failed") or state[1] == 0


class Ordered(StatefulProcessor):
    """Runs a machine for each key over its events in order. State of a key: the machine's, the time up to which events were taken, and the
    events that wait for the watermark. Those wait in lists, an entry for each batch, and rows go in and out as such: frames and entries
    for single events cost a key of a few dozen events far more than its machine."""

    def __init__(self, machine, keep: int):
        self.machine, self.keep = machine, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", f"{self.machine.schema}, seen long")
        self.waiting = handle.getListState("waiting", "ts array<long>, event_id array<long>, kind array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = [(row.ms, row.event_id, row.kind) for row in rows]
        self.waiting.appendList(chunks(found))
        self.handle.registerTimer(min(found, key=lambda e: e[0])[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, machine = timerValues.getCurrentWatermarkInMs(), self.machine
        *state, seen = self.state.get() or (*machine.start, -1)
        state, out = tuple(state), []

        def until(time: int) -> None:
            nonlocal state
            while (due := machine.due(state)) is not None and due <= time:
                state, rows = machine.fire(state)
                out.extend(rows)

        events = sorted(e for chunk in self.waiting.get() for e in zip(*chunk))
        ready = [e for e in events if e[0] <= now]
        for ts, event_id, kind in ready:
            until(ts)
            state, rows = machine.step(key[0], state, ts, event_id, kind)
            out.extend(rows)
            seen = ts
        until(now)  # a due time lies one behind the last moment at which an event would still have come first
        left = events[len(ready) :]
        if ready:
            self.waiting.put(chunks(left)) if left else self.waiting.clear()
        if not left and machine.rests(state) and now >= seen + self.keep:
            self.state.clear()
        else:
            self.state.update((*state, seen))
            wake = [machine.due(state), left[0][0] if left else None, seen + self.keep if machine.rests(state) else None]
            for at in {min(w for w in wake if w is not None)} if any(w is not None for w in wake) else ():
                self.handle.registerTimer(max(at, now + 1))
        return (Report(key[0], *row) for row in out)

    def close(self) -> None:
        pass


def watched(events: DataFrame, machine, delay: str = "0 seconds", keep_days: float = 90) -> DataFrame:
    """key, at, event_id, what, n: what a machine reports of a stream of events. Rows later than `delay` are dropped."""
    slim = events.selectExpr("key", "date_trunc('millisecond', ts) AS ts", "event_id", "kind", "unix_millis(date_trunc('millisecond', ts)) AS ms").withWatermark("ts", delay)
    found = slim.groupBy("key").transformWithState(Ordered(machine, int(keep_days * 86_400_000)), OUT_DDL, "append", "eventTime")
    return found.withColumn("at", F.timestamp_millis("at"))


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
