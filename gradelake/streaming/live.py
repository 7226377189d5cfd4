"""The live frame loop: detection at most every 140 ms, a state with hysteresis, and a smoothed outline.

One step function serves both forms: a stateful stream keyed by session, and a fold over recorded frames.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Interval in ms, least confidence and coverage, near and far coverage, misses until lost, smoothing.
INTERVAL, CONFIDENT, COVERED, FAR, CLOSE, MISSES, SMOOTH = 140, 0.6, 0.1, 0.30, 0.90, 4, 0.4

STATE = "last_t bigint, target double, smooth double, lost int, state string"
OUTPUT = "session bigint, frame bigint, t_ms bigint, sampled boolean, state string, smooth double"


@dataclass
class Tracker:
    """What a session remembers; ``target`` and ``smooth`` stand for an outline's position."""

    last_t: int = -INTERVAL - 1
    target: float | None = None
    smooth: float | None = None
    lost: int = 0
    state: str = "searching"

    def step(self, t: int, confidence: float, coverage: float, position: float) -> bool:
        """Take one frame in; tells whether it was sampled."""
        sampled = t - self.last_t > INTERVAL
        if sampled:
            self.last_t = t
            if confidence > CONFIDENT and coverage > COVERED:
                self.target, self.lost = position, 0
                self.state = "far" if coverage < FAR else "close" if coverage > CLOSE else "found"
            else:
                self.lost += 1
                if self.lost > MISSES:
                    self.target, self.state = None, "searching"
        if self.target is None:
            self.smooth = None
        else:
            self.smooth = self.target if self.smooth is None else self.smoothed()
        return sampled

    def smoothed(self) -> float:
        """Part of the way from where the outline is shown to where it was found."""
        return self.smooth + (self.target - self.smooth) * SMOOTH


def _run(session: int, tracker: Tracker, frames: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for f in frames.sort_values(["t_ms", "frame"]).itertuples():
        sampled = tracker.step(f.t_ms, f.confidence, f.coverage, f.position)
        rows.append((session, f.frame, f.t_ms, sampled, tracker.state, tracker.smooth))
    return pd.DataFrame(rows, columns=["session", "frame", "t_ms", "sampled", "state", "smooth"])


def replay(frames: DataFrame) -> DataFrame:
    """All frames of recorded sessions: ``session, frame, t_ms, confidence, coverage, position``.

    A session is one sequence, so it is one group; sessions are minutes long.
    """
    return frames.groupBy("session").applyInPandas(lambda key, pdf: _run(key[0], Tracker(), pdf), OUTPUT)


def track(frames: DataFrame, idle_ms: int | None = 60_000) -> DataFrame:
    """The same on a stream of frames; the state of a session is five values and is dropped after ``idle_ms`` without frames.

    Without ``idle_ms`` nothing times out, so a query over a finished input ends.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker()
        if state.exists:
            last_t, target, smooth, lost, name = state.get
            tracker = Tracker(last_t, target, smooth, lost, name)
        frames = pd.concat(list(batches))
        yield _run(key[0], tracker, frames)
        state.update((tracker.last_t, tracker.target, tracker.smooth, tracker.lost, tracker.state))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.groupBy("session").applyInPandasWithState(update, OUTPUT, STATE, "append", timeout)


def accepted(frames: DataFrame) -> DataFrame:
    """Frames good enough to update the outline, and whether one may be captured without the manual step."""
    return frames.where((F.col("confidence") > CONFIDENT) & (F.col("coverage") > COVERED)).withColumn("direct", F.col("confidence") >= 0.8)


def miss_runs(frames: DataFrame) -> DataFrame:
    """Runs of consecutive frames that were not accepted, with their length: gaps and islands in one window."""
    order = Window.partitionBy("session").orderBy("t_ms", "frame")
    good = (F.col("confidence") > CONFIDENT) & (F.col("coverage") > COVERED)
    rows = frames.withColumn("good", good).withColumn("island", F.count_if("good").over(order))
    return rows.where("not good").groupBy("session", "island").agg(F.min("t_ms").alias("from_ms"), F.count("*").alias("frames")).withColumn("lost", F.col("frames") > MISSES)
