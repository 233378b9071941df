"""Sliding-log rate limiting. An admission depends on earlier admissions, so it is state, in batches and in streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, MutableSequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def admit(times: Iterable[float], log: MutableSequence[float], limit: int, window: float) -> list[bool]:
    """Whether each request, in order, is admitted; only admitted ones enter the log, and one of `window` seconds ago is out of it."""
    out = []
    for t in times:
        while log and log[0] <= t - window:
            del log[0]
        out.append(limit <= 0 or len(log) < limit)
        if out[-1] and limit > 0:
            log.append(t)
    return out


def rate_limit_admissions(events: DataFrame, limit: int = 2, window: float = 60.0) -> DataFrame:
    """event_id, user_id, admitted. Requests of a subject are ordered by time, then id.

    Subjects are dealt to partitions and sorted there, and the batches stream through with the log of the current subject, which holds at
    most `limit` times: a subject's history is never gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, log = object(), deque()
        for b in batches:
            admitted: list[bool] = []
            for user, t in zip(b["user_id"], b["t"] / 1e6):
                if user != subject and not (pd.isna(user) and pd.isna(subject)):
                    subject, log = user, deque()
                admitted += admit([t], log, limit, window)
            yield pd.DataFrame({"event_id": b["event_id"], "user_id": b["user_id"], "admitted": admitted}).astype({"user_id": "Int64"})

    own = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return own.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInPandas(run, "event_id long, user_id long, admitted boolean")


class _Limiter(StatefulProcessor):
    """The log of a subject as state: a list of at most `limit` times, which an event-time timer clears once they are out of the window."""

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "t double")

    def _keep(self, log: list[float]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if log:
            self.log.put([(t,) for t in log])
            self.handle.registerTimer(int(max(log) * 1000 + self.window * 1000) + 1)
        else:
            self.log.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        g = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # one subject's requests of one micro-batch
        log = [t for (t,) in self.log.get()] if self.log.exists() else []
        seconds = (g["ts"] - pd.Timestamp(0)).dt.total_seconds().tolist()
        out = pd.DataFrame({"event_id": g["event_id"], "user_id": g["user_id"], "admitted": admit(seconds, log, self.limit, self.window)})
        self._keep(log)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.log.clear()
        yield from ()

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_limit_stream(events: DataFrame, limit: int = 2, window: float = 60.0, late: str = "1 minute") -> DataFrame:
    """The same over a stream. The state of a subject is its log, at most `limit` times, kept in RocksDB and removed by a timer when the
    watermark, `late` behind the newest request, has passed the window of the last admitted one: state grows with the subjects of a
    window, not with all that were ever seen. Requests that come later than the watermark are dropped. Requests of one micro-batch are
    taken in the order of time, then id; batches in the order that they come. Null times are dropped, as no window holds them."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).where(F.col("ts").isNotNull()).withWatermark("ts", late)
    return own.groupBy("user_id").transformWithStateInPandas(_Limiter(limit, window), "event_id long, user_id long, admitted boolean", "append", "eventTime")
