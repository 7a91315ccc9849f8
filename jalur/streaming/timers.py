"""The state of each job with timers: a job that is stale goes back to the queue, and what is over is forgotten."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import MOVE, MOVES

#: Seconds without an event after which a running job is stale, and for which a job that is over is remembered.
STALE, KEPT = 300.0, 86_400.0
#: The store of states that timers and expiry need; a session's setting before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "status string, updated timestamp, started timestamp, recoveries int"
_COLUMNS = ["job_id", "event", "from_status", "to_status", "accepted", "at", "seconds", "recoveries"]


def _plain(t: Any):
    return None if t is None or pd.isna(t) else pd.Timestamp(t).to_pydatetime()


class Jobs(StatefulProcessor):
    """A job's status; one timer while it runs."""

    def __init__(self, stale: float, kept: float):
        self.stale, self.kept = int(stale * 1000), int(kept * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # states that nothing touches expire
        self.job = handle.getValueState("job", _STATE, self.kept)

    def _timer(self, now: int, running: bool) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if running:
            self.handle.registerTimer(now + self.stale)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, updated, started, recoveries = self.job.get() if self.job.exists() else (None, None, None, 0)
        out = []
        events = pd.concat(list(rows)).sort_values(["at", "event"], kind="stable")
        for event, at in zip(events["event"], events["at"], strict=True):
            allowed, to = MOVES.get(event, (set(), status))
            ok = status in allowed
            took = (at - pd.Timestamp(started)).total_seconds() if ok and status == "running" and started is not None else None
            out.append((key[0], event, status, to if ok else status, ok, at, took, recoveries))
            if ok:
                status, updated, started = to, at, at if to == "running" else started
        if status is not None:
            self.job.update((status, _plain(updated), _plain(started), int(recoveries)))
        self._timer(timerValues.getCurrentProcessingTimeInMs(), status == "running")
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = []
        if self.job.exists():
            status, _, _, recoveries = self.job.get()
            if status == "running":
                now = pd.Timestamp(timerValues.getCurrentProcessingTimeInMs(), unit="ms")
                self.job.update(("queued", now.to_pydatetime(), None, int(recoveries) + 1))
                out.append((key[0], "sweep", status, "queued", True, now, None, int(recoveries) + 1))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        """Nothing is held open."""


def timed_moves(events: DataFrame, stale: float = STALE, kept: float = KEPT) -> DataFrame:
    """Every event of a stream (job_id, event, at) as a move of its job, and the sweeps of stale jobs, as jobs.moves() says.

    A running job of which nothing is heard for `stale` seconds goes back to the
    queue by its timer, whether or not other jobs have events; it may be claimed
    again and completed.  States that nothing has touched for `kept` seconds
    are gone, so that the store doesn't grow with all jobs there ever were.
    The session must use STORE.
    """
    return events.groupBy("job_id").transformWithStateInPandas(Jobs(stale, kept), MOVE, "Append", "ProcessingTime")


class Once(StatefulProcessor):
    """The first event of a key; the key is forgotten after a time."""

    def __init__(self, kept: float, columns: list[str]):
        self.kept, self.columns = int(kept * 1000), columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.kept)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = next((f for f in rows if len(f)), None)
        for _ in rows:
            pass
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first[self.columns].head(1)

    def close(self) -> None:
        """Nothing is held open."""


def once(events: DataFrame, key: str, kept: float = KEPT) -> DataFrame:
    """Of each key one event, the first to come; a key is forgotten `kept` seconds after it, so that the state is bounded by the keys of that time."""
    return events.groupBy(key).transformWithStateInPandas(Once(kept, events.columns), events.schema, "Append", "ProcessingTime")
