"""The live frame loop on outlines: eight coordinates are smoothed together, and a session ends by its own clock.

``frames`` has ``session, frame, at`` (event time), ``t_ms, confidence, coverage`` and the corners of the outline found.
The stream keeps typed state per session with a timer in event time; the replay folds recorded frames by the same step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradelake.operators.geometry import CORNERS
from gradelake.streaming.live import SMOOTH, Tracker

NAMES = [f"{c}_{axis}" for c in CORNERS for axis in "xy"]
OUTPUT = "session bigint, frame bigint, t_ms bigint, sampled boolean, state string, " + ", ".join(f"{n} double" for n in NAMES)
STATE = "seen bigint, last_t bigint, lost int, state string, target array<double>, smooth array<double>"
#: Milliseconds without frames after which a session is forgotten.
IDLE_MS = 60_000


class QuadTracker(Tracker):
    """A tracker whose position is a list of coordinates."""

    def smoothed(self) -> list[float]:
        return [a + (b - a) * SMOOTH for a, b in zip(self.smooth, self.target, strict=True)]


def _run(session: int, tracker: QuadTracker, seen: int | None, idle_ms: int, frames: pd.DataFrame) -> tuple[QuadTracker, pd.DataFrame]:
    """The frames in order, after a last one at ``seen``; a pause of over ``idle_ms`` starts anew."""
    frames = frames.sort_values(["t_ms", "frame"])
    rows = []
    for f, t, sure, cover, quad in zip(frames["frame"], frames["t_ms"], frames["confidence"], frames["coverage"], frames[NAMES].to_numpy(float).tolist(), strict=True):
        if seen is not None and t - seen > idle_ms:
            tracker = QuadTracker()
        seen = t if seen is None else max(t, seen)
        sampled = tracker.step(t, sure, cover, quad)
        rows.append((session, f, t, sampled, tracker.state, *(tracker.smooth or [None] * len(NAMES))))
    return tracker, pd.DataFrame(rows, columns=["session", "frame", "t_ms", "sampled", "state", *NAMES])


def replay(frames: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """All frames of recorded sessions, in order of ``t_ms``, then ``frame``.

    A pause of over ``idle_ms`` ends a sitting and the next frame starts anew, so a group is one sitting, however long a user's history is.
    """
    gap = F.expr("t_ms - lag(t_ms) over (partition by session order by t_ms, frame)") > idle_ms
    rows = frames.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
    rows = rows.withColumn("_sitting", F.expr("sum(_new) over (partition by session order by t_ms, frame)"))
    return rows.groupBy("session", "_sitting").applyInPandas(lambda key, pdf: _run(key[0], QuadTracker(), None, idle_ms, pdf)[1], OUTPUT)


class _Sessions(StatefulProcessor):
    """State of one session: the last frame's time, the tracker's five values, and one timer that ends it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("tracker", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracker, seen = QuadTracker(), None
        if self.seen.exists():
            seen, last_t, lost, name, target, smooth = self.seen.get()
            tracker = QuadTracker(last_t, target and list(target), smooth and list(smooth), lost, name)
        frames = pd.concat(list(rows))
        tracker, out = _run(key[0], tracker, seen, self.idle_ms, frames)
        last = int(frames["t_ms"].max())
        self.seen.update((last if seen is None else max(last, seen), int(tracker.last_t), int(tracker.lost), tracker.state, tracker.target, tracker.smooth))
        ends = int(frames["at"].max().timestamp() * 1000) + self.idle_ms
        timers = list(self.handle.listTimers())
        if not timers or max(timers) < ends:
            for old in timers:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ends)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        row = {"session": key[0], "frame": None, "t_ms": None, "sampled": False, "state": "ended"} | dict.fromkeys(NAMES)
        yield pd.DataFrame([row]).astype({"frame": "Int64", "t_ms": "Int64"} | dict.fromkeys(NAMES, "float64"))

    def close(self) -> None:
        pass


def track(frames: DataFrame, idle_ms: int = IDLE_MS, late: str = "10 seconds") -> DataFrame:
    """The same on a stream, with a row of state ``ended`` for each session whose last frame is ``idle_ms`` behind the watermark.

    Frames later than ``late`` are dropped; an older frame that comes within that time is passed over (not sampled).
    The session needs a state store that keeps timers (``spark.sql.streaming.stateStore.providerClass`` of RocksDB).
    """
    return frames.withWatermark("at", late).groupBy("session").transformWithStateInPandas(_Sessions(idle_ms), OUTPUT, "append", "eventTime")


def event_time(frames: DataFrame, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """``at`` from ``t_ms``: milliseconds since ``start``."""
    return frames.withColumn("at", F.expr(f"timestamp_millis(unix_millis(timestamp'{start}') + t_ms)"))
