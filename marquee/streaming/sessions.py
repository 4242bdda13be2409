"""Sessions as keyed state that expires by the clock of the stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"
EXPIRED = "session_key string, started long, ended long, n long"
Session = tuple[int, int, int]


def micros(ts: str) -> F.Column:
    """A time without zone as microseconds, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def from_micros(us: str) -> F.Column:
    return F.expr(f"timestampadd(MICROSECOND, {us}, {EPOCH})")


def merged(sessions: list[Session], ttl: int) -> list[Session]:
    """Sessions (start, end, n) of one key, those at most `ttl` apart made one."""
    out: list[Session] = []
    for start, end, n in sorted(sessions):
        if out and start - out[-1][1] <= ttl:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


class SessionExpiry(StatefulProcessor):
    """Keeps the open sessions of a key; each has a timer at its last event plus `ttl_us`.

    An event within the time to live of an open session extends it and moves its timer, one
    that lies between two makes them one. When the watermark passes the timer the session is
    told and forgotten, so state holds only what may still change. An event that comes later
    than the watermark is left out, as its session may be gone.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "started long, ended long, n long")

    def _timer(self, session: Session) -> int:
        return (session[1] + self.ttl_us) // 1000 + 1

    def _keep(self, sessions: list[Session]) -> None:
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        before = [tuple(s) for s in self.open.get()]
        sessions = list(before)
        for batch in rows:
            times = batch["us"][batch["us"] >= now * 1000].tolist()
            sessions = merged(sessions + [(t, t, 1) for t in times], self.ttl_us)
        for gone in {self._timer(s) for s in before} - {self._timer(s) for s in sessions}:
            self.handle.deleteTimer(gone)
        for new in {self._timer(s) for s in sessions} - {self._timer(s) for s in before}:
            self.handle.registerTimer(new)
        self._keep(sessions)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        sessions = [tuple(s) for s in self.open.get()]
        over = [s for s in sessions if self._timer(s) <= at]
        self._keep([s for s in sessions if self._timer(s) > at])
        if over:
            yield pd.DataFrame([(key[0], *s) for s in over], columns=["session_key", "started", "ended", "n"])

    def close(self) -> None:
        pass


def expired_sessions(events: DataFrame, key: str, ts: str, ttl: str = "72 hours", late: str = "1 day") -> DataFrame:
    """(session_key, started, ended, n) of the sessions of a stream that are over.

    A session ends when no event of its key came for `ttl`; it is told once the latest
    time seen less `late` is past that. started and ended are microseconds.
    """
    ttl_us = int(events.sparkSession.sql(f"select timestampdiff(MICROSECOND, {EPOCH}, {EPOCH} + interval {ttl})").first()[0])
    timed = events.select(F.col(key).cast("string").alias("session_key"), micros(ts).alias("us")).where("session_key is not null and us is not null")
    return (
        timed.withColumn("at", F.timestamp_micros("us"))
        .withWatermark("at", late)
        .groupBy("session_key")
        .transformWithStateInPandas(SessionExpiry(ttl_us), EXPIRED, "append", "eventTime")
    )
