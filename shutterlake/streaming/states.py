"""A job's states as a stream: a state processor that orders, checks and expires updates.

A job goes queued, running, completed or failed; it may fail before it runs.  An update
that comes before the one it needs waits for it, in state; repeats go; what can't
follow is refused.  A job that isn't heard of for a while expires, and a finished one
is forgotten, both by timers in event time, so state doesn't grow with all jobs ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What may follow a state (none: before the first).
FOLLOWS = {None: ("queued",), "queued": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}
#: How far along a state is.
STAGE = {"queued": 0, "running": 1, "completed": 2, "failed": 2}
MOVES = "key string, before string, status string, ts timestamp, outcome string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(status: str | None, waiting: list[tuple], updates: list[tuple]) -> tuple[str | None, list[tuple], list[tuple]]:
    """(status, what still waits, moves) after updates, each (ts, status).

    Moves are (before, status, ts, outcome): ``moved`` or ``refused``.  Updates are taken by
    time, then by stage.  One that a later state needs first may come late, and takes its
    place as long as that one waits.
    """
    queue = sorted({*waiting, *updates}, key=lambda u: (u[0], STAGE.get(u[1], 9), u[1]))
    moves: list[tuple] = []
    again = True
    while again:
        again, left = False, []
        for ts, new in queue:
            if new not in STAGE:
                moves.append((status, new, ts, "refused"))
            elif new in FOLLOWS[status]:
                moves.append((status, new, ts, "moved"))
                status, again = new, True
            elif status is not None and (new == status or STAGE[new] < STAGE[status]):
                continue  # a repeat, or a stage that the job has passed
            elif status is not None and not FOLLOWS[status]:
                moves.append((status, new, ts, "refused"))
            else:
                left.append((ts, new))
        queue = left
    return status, queue, moves


class JobStates(StatefulProcessor):
    """State of one job: its status and time, the updates that wait, and one timer."""

    def __init__(self, idle_ms: int, keep_ms: int):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "status string, seen long, until long")
        self.waiting = handle.getListState("waiting", "ts long, status string")

    def _state(self) -> tuple[str | None, int, int | None, list[tuple]]:
        status, seen, until = self.current.get() if self.current.exists() else (None, 0, None)
        return status, seen, until, [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []

    def _expired(self) -> list[tuple]:
        """Ends the job: what waits is refused, and a job that isn't done has expired."""
        status, seen, _, waiting = self._state()
        moves = [(status, new, ts, "refused") for ts, new in sorted(waiting)]
        if status is None or FOLLOWS[status]:
            moves.append((status, "expired", seen, "moved"))
        self.current.clear()
        self.waiting.clear()
        return moves

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        *_, until, _ = self._state()
        # Rows come before timers: a job whose time is over ends first.
        before = self._expired() if until is not None and until <= watermark else []
        status, seen, _, waiting = self._state()
        updates = [(t.value // 1000, s) for part in rows for t, s in zip(part["ts"], part["status"], strict=True)]
        status, waiting, moves = advance(status, waiting, updates)
        seen = max(seen, *[t for t, _ in updates])
        done = status is not None and not FOLLOWS[status]
        until = max(seen // 1000 + (self.keep_ms if done else self.idle_ms), watermark + 1)
        self.current.update((status, seen, until))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        yield told(key[0], before + moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield told(key[0], self._expired())

    def close(self) -> None:
        pass


def told(key: str, moves: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame([(key, *m) for m in moves], columns=["key", "before", "status", "ts", "outcome"])
    return made.astype({"key": object, "before": object, "status": object, "outcome": object}).assign(ts=pd.to_datetime(made["ts"].astype("int64"), unit="us"))


def use_state_store(spark: SparkSession) -> None:
    """State processors need this store of states."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def job_states(updates: DataFrame, *, key: str, ts: str, status: str, late: str = "10 minutes", idle: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """``key, before, status, ts, outcome``: the moves of each job, append mode.

    ``late``: how long the watermark waits; ``idle``: when a job that isn't done and isn't
    heard of expires (status ``expired``; what waited is refused); ``keep``: how long
    repeats of a finished job are known.  Updates with a null in any of the columns are left
    out.  A frame that isn't a stream gives all moves at once, without expiry.
    """
    rows = updates.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(status).alias("status")).dropna()
    ms = lambda span: int(pd.Timedelta(span).total_seconds() * 1000)
    if not rows.isStreaming:
        return rows.groupBy("key").applyInPandas(_all_moves, MOVES)
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(statefulProcessor=JobStates(ms(idle), ms(keep)), outputStructType=MOVES, outputMode="append", timeMode="eventTime")


def _all_moves(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    _, waiting, moves = advance(None, [], [(t.value // 1000, s) for t, s in zip(part["ts"], part["status"], strict=True)])
    return told(key[0], [*moves, *[(None, new, ts, "refused") for ts, new in waiting]])
