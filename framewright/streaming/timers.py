"""Ticks and time-outs that fire without a row: keyed state with event-time timers.

Rows of a key wait until the watermark has passed them and are then taken in event time, whatever micro-batches they came in and in whatever order; what falls due between two of them (a tick, a time-out) is taken at its own
time. Timers wake a key that gets no more rows. So a stream gives the rows of the batch twins in ``operators/sessions.py`` for all times that the watermark has passed. A key holds its rows of the watermark's delay and a few numbers.

Times are whole milliseconds. Needs the RocksDB state store (``state_store`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Rule:
    """What a key does with its rows. ``start`` is a new key's state, a tuple of the fields of ``state``; a state of None is dropped."""

    state: str
    start: tuple

    def row(self, state: tuple, t: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When something falls due if no row comes before or at that time."""
        raise NotImplementedError

    def fire(self, state: tuple, t: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError


class _InOrder(StatefulProcessor):
    def __init__(self, rule: Rule, fields: str, columns: list[str]):
        self.rule, self.fields, self.columns = rule, fields, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.fields)
        self.now = handle.getValueState("now", self.rule.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.held.appendList([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row) for row in part[self.columns].itertuples(index=False)])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Take everything before the watermark in order, then set the one timer that the key needs next."""
        rule, out = self.rule, []
        state = tuple(self.now.get()) if self.now.exists() else rule.start
        waiting = sorted(self.held.get(), key=lambda r: (r[0], *[(v is not None, v) for v in r[1:]])) if self.held.exists() else []
        ready = 0
        while state is not None:
            t = waiting[ready][0] if ready < len(waiting) else None
            due = rule.due(state)
            if due is not None and due < watermark and (t is None or due < t):
                state, new = rule.fire(state, due)
            elif t is not None and t < watermark:
                state, new = rule.row(state, t, waiting[ready][1:])
                ready += 1
            else:
                break
            out += new
            if state is None and ready < len(waiting):
                state = rule.start  # more rows came after what ended it
        left = waiting[ready:]
        self.held.put(left) if left else self.held.clear()
        self.now.clear() if state is None else self.now.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        soonest = [x for x in (left[0][0] if left else None, rule.due(state) if state is not None else None) if x is not None]
        if soonest:
            self.handle.registerTimer(max(min(soonest), watermark) + 1)
        if out:
            yield pd.DataFrame([(*key, *o) for o in out], columns=self.names)


def in_event_time(stream: DataFrame, key: str, time: str, late: str, columns: list[str], rule: Rule, output: str) -> DataFrame:
    """Apply a rule to the rows (time and columns) of each key. output: DDL of the key and what the rule gives."""
    rows = stream.withWatermark(time, late).withColumn("order_ms", F.expr(f"unix_millis(`{time}`)"))
    kinds = dict(rows.dtypes)
    processor = _InOrder(rule, ", ".join(["order_ms long", *[f"`{c}` {kinds[c]}" for c in columns]]), ["order_ms", *columns])
    processor.names = [f.strip().split(" ")[0].strip("`") for f in output.split(",")]
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="eventtime")


class _Ticks(Rule):
    """state: the next tick (-1 before the start), the end (-1 while unknown), the last sample's time (-1 without one) and value."""

    state, start = "tick long, until long, seen long, value double", (-1, -1, -1, 0.0)

    def __init__(self, period: int, max_age: int):
        self.period, self.max_age = period, max_age

    def _next(self, tick: int, t: int) -> int:
        """The first tick at or after t."""
        return tick + max(0, -(-(t - tick) // self.period)) * self.period

    def row(self, state, t, row):
        (kind, value), (tick, until, seen, held) = row, state
        if kind == "start":
            return (t if tick < 0 else tick, until, seen, held), []
        if kind == "end":
            return ((tick, t, seen, held), []) if tick >= 0 else (state, [])
        return (self._next(tick, t) if tick >= 0 else tick, until, t, value), []

    def due(self, state):
        tick, until, seen, _ = state
        # ticks that no sample reaches give nothing and are passed over; one past the end ends the session
        if tick < 0 or (seen < 0 and until < 0):
            return None
        if until >= 0 and (tick > until or seen < 0 or tick - seen > self.max_age):
            return max(until, seen)
        return tick if tick - seen <= self.max_age else None

    def fire(self, state, t):
        tick, until, seen, value = state
        if until >= 0 and (tick > until or seen < 0 or tick - seen > self.max_age):
            return None, []
        return (tick + self.period, until, seen, value), [(tick, value)]


def tick_samples(stream: DataFrame, period: int, max_age: int, late: str) -> DataFrame:
    """session, tick (milliseconds), value: the latest sample at each tick of a session, every ``period`` from its start marker to its end marker; ticks without a sample of at most ``max_age`` are left out.

    Rows: session, ts, kind (start, end, sample), value. A session that has ended is forgotten once the watermark has passed its end."""
    return in_event_time(stream, "session", "ts", late, ["kind", "value"], _Ticks(period, max_age), "session string, tick long, value double")


class _Holds(Rule):
    """state: whether it may fire, since when both are held (-1 if not), the last input's time (-1 if cleared) and source."""

    state, start = "armed boolean, since long, last long, source string", (True, -1, -1, "")

    def __init__(self, hold: int, timeout: int):
        self.hold, self.timeout = hold, timeout

    def row(self, state, t, row):
        (source, left, right), (armed, since, last, by) = row, state
        if left is None or right is None:
            return self.start, []
        if last >= 0 and source != by:
            armed, since = True, -1
        if not left and not right:
            return (True, -1, t, source), []
        if not (left and right):
            return (armed, -1, t, source), []
        since = t if since < 0 else since
        fires = armed and t - since >= self.hold
        return (armed and not fires, since, t, source), [(t, "fired")] if fires else []

    def due(self, state):
        return state[2] + self.timeout if state[2] >= 0 else None

    def fire(self, state, t):
        return None, [(t, "cleared")]


def dual_holds(stream: DataFrame, hold: int, timeout: int, late: str) -> DataFrame:
    """session, t (milliseconds), event: ``fired`` when both of left and right had been held so long, ``cleared`` when no input came for ``timeout``, which forgets the key. Rows: session, ts, source, left, right."""
    return in_event_time(stream, "session", "ts", late, ["source", "left", "right"], _Holds(hold, timeout), "session string, t long, event string")
