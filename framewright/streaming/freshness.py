"""Structured Streaming: freshness of the latest values, tick sampling, gesture and episode events.

State is keyed (device, session or source) and a few bytes a key: numbers of episodes, aborts, pressed buttons and last values are kept for as long as the query runs, however long a key is idle, so streams
and their batch twins in ``operators/sessions.py`` agree, and nothing depends on a machine's clock. The step functions are plain. Ticks and time-outs that fire without a row are in ``streaming/timers.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TOLERANCE = 1e-12


def _keyed(stream: DataFrame, key: str, step, start: tuple, output: str, fields: str) -> DataFrame:
    """step(key, rows in order, state) -> (output rows, state) for the rows of a key in each micro-batch; ``start`` is the state of a new key."""
    names = [f.strip().split(" ")[0].strip("`") for f in output.split(",")]

    def run(of, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, after = step(of[0], pd.concat(list(batches), ignore_index=True), state.get if state.exists else start)
        state.update(tuple(after))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, output, fields, "append", GroupStateTimeout.NoTimeout)


def edges(previous: int, pressed: int) -> list[tuple[int, bool]]:
    """(button, pressed) of every bit that changed; the first sample compares with all released."""
    changed = previous ^ pressed
    return [(b, bool(pressed >> b & 1)) for b in range(changed.bit_length()) if changed >> b & 1]


def button_events(stream: DataFrame) -> DataFrame:
    """device, t, button, pressed for each change in device, t, buttons (bits). Rows of one micro-batch are taken in time order."""

    def step(device, rows, state):
        previous, out = state[0], []
        rows = rows.sort_values("t", kind="stable")
        for t, pressed in zip(rows["t"], rows["buttons"]):
            out += [(device, t, b, p) for b, p in edges(previous, int(pressed))]
            previous = int(pressed)
        return out, (previous,)

    return _keyed(stream, "device", step, (0,), "device string, t double, button int, pressed boolean", "buttons int")


def hold_step(state: tuple[bool, float | None], t: float, left: bool, right: bool, hold: float) -> tuple[tuple[bool, float | None], bool]:
    """Both buttons held for ``hold`` seconds fire once; firing disarms until both are released. Releasing one restarts the time."""
    armed, since = state
    if not left and not right:
        return (True, None), False
    if not (left and right):
        return (armed, None), False
    since = t if since is None else since
    if armed and t - since >= hold - TOLERANCE:
        return (False, since), True
    return (armed, since), False


def dual_holds(stream: DataFrame, hold: float = 1.0, timeout: float = 0.25) -> DataFrame:
    """session, t at which both of left and right had been held (session, t, source, left, right). A gap longer than ``timeout``, another source or an invalid (null) input clears the state."""

    def step(session, rows, state):
        armed, since, last, source = state
        now, fired = (armed, None if since < 0 else since), []
        rows = rows.sort_values("t", kind="stable")
        for t, by, left, right in zip(rows["t"], rows["source"], rows["left"], rows["right"]):
            if pd.isna(left) or pd.isna(right):
                now, last, source = (True, None), -1.0, ""
                continue
            if last >= 0 and (t - last > timeout + TOLERANCE or by != source):
                now = (True, None)
            now, fire = hold_step(now, t, bool(left), bool(right), hold)
            if fire:
                fired.append((session, t))
            last, source = float(t), by
        return fired, (now[0], -1.0 if now[1] is None else float(now[1]), last, source)

    return _keyed(stream, "session", step, (True, -1.0, -1.0, ""), "session string, t double", "armed boolean, since double, last double, source string")


def session_step(state: tuple[int, bool], kind: str, task: str | None) -> tuple[tuple[int, bool], str]:
    """state: the number of the next episode, and whether one records. The verdict of a start or end marker: started, ended or refused."""
    number, records = state
    if kind == "start":
        return ((number, records), "refused") if records or not (task or "").strip() else ((number, True), "started")
    return ((number + 1, False), "ended") if records else ((number, False), "refused")


def episode_events(stream: DataFrame) -> DataFrame:
    """source, t, episode, event (started, ended, refused) of start and end markers (source, t, kind, task)."""

    def step(source, rows, state):
        now, out = state, []
        rows = rows.sort_values(["t", "kind"], kind="stable")
        for t, kind, task in zip(rows["t"], rows["kind"], rows["task"]):
            number = now[0]
            now, event = session_step(now, kind, None if pd.isna(task) else task)
            out.append((source, t, number, event))
        return out, now

    return _keyed(stream, "source", step, (0, False), "source string, t double, episode long, event string", "number long, records boolean")


def abort_step(state: dict, ages: dict[str, float | None], limits: dict[str, float], counts: dict[str, int], window: int = 30, most: float = 1 / 28) -> str:
    """The verdict of a tick: ok, stale <input> or abort <why>; changes the state (stale counts, and the last ages of the last input while all are fresh). Inputs are looked at in the order of ``limits``."""
    for name, limit in limits.items():
        age = ages.get(name)
        if age is None or age > limit + TOLERANCE:
            state[name] = state.get(name, 0) + 1
            return f"{'abort' if state[name] >= counts[name] else 'stale'} {name}"
    recent = state.setdefault("ages", [])
    recent.append(ages[name])
    del recent[:-window]
    return "abort average" if len(recent) == window and sum(recent) / window > most else "ok"


def abort_verdicts(stream: DataFrame, limits: dict[str, float], counts: dict[str, int], window: int = 30, most: float = 1 / 28) -> DataFrame:
    """session, t, verdict of each tick (session, t and an age for each input) until the first abort; later ticks of an aborted session give no row."""
    names = list(limits)

    def step(session, rows, state):
        held, out = dict(zip(names, state[: len(names)])) | {"ages": list(state[len(names)])}, []
        aborted = state[-1]
        for row in rows.sort_values("t", kind="stable").to_dict("records"):
            if not aborted:
                verdict = abort_step(held, {n: None if pd.isna(row[n]) else float(row[n]) for n in names}, limits, counts, window, most)
                out.append((session, row["t"], verdict))
                aborted = verdict.startswith("abort")
        return out, (*[held[n] for n in names], held["ages"], aborted)

    fields = ", ".join([*[f"`{n}` long" for n in names], "ages array<double>", "aborted boolean"])
    return _keyed(stream, "session", step, (*[0] * len(names), [], False), "session string, t double, verdict string", fields)


def snapshots(stream: DataFrame, limits: dict[str, float]) -> DataFrame:
    """session, tick, verdict for each tick row: ok, or the missing inputs, else the stale ones. Rows: session, t, kind (an input or 'tick')."""
    names = sorted(limits)

    def step(session, rows, state):
        seen, out = list(state), []
        rows = rows.assign(_tick=rows["kind"] == "tick").sort_values(["t", "_tick"], kind="stable")
        for t, kind in zip(rows["t"], rows["kind"]):
            if kind in limits:
                seen[names.index(kind)] = float(t)
            elif kind == "tick":
                missing = [n for n, s in zip(names, seen) if s < 0]
                stale = [n for n, s in zip(names, seen) if s >= 0 and t - s > limits[n] + TOLERANCE]
                out.append((session, t, "missing " + ",".join(missing) if missing else "stale " + ",".join(stale) if stale else "ok"))
        return out, seen

    return _keyed(stream, "session", step, (-1.0,) * len(names), "session string, tick double, verdict string", ", ".join(f"`{n}` double" for n in names))


def windowed_rates(stream: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Counts and mean values by event type and event-time window, with a watermark (an extension: the recorder has none)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("window.start", "event_type", "n", "mean")
