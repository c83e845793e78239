"""Keyed state with event-time timers: token buckets for each host, on ``transformWithState``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Tokens a second, tokens at most, and idle seconds after which a host is forgotten (fixed defaults).
RATE, BURST, IDLE_S = 1.0, 3, 900

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADMITTED = "host string, request_id long, asked timestamp, admitted timestamp, wait_ms long"


class _Buckets(StatefulProcessor):
    """Each host has the time at which its bucket is full again; a request takes a token at once or waits for the next."""

    def __init__(self, rate: float, burst: int, idle_s: int) -> None:
        self.step, self.burst, self.idle = 1000.0 / rate, burst, idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.full = handle.getValueState("full_at", "ms double")
        self.timer = handle.getValueState("forget_at", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        full = self.full.get()[0] if self.full.exists() else float("-inf")
        latest, out = 0, []
        frame = pd.concat(list(rows))
        for asked, request in sorted(zip(frame["asked"], frame["request_id"], strict=True)):
            now = asked.timestamp() * 1000
            full = max(full, now) + self.step  # one token is taken
            wait = max(0.0, full - now - self.burst * self.step)
            latest = max(latest, int(now))
            out.append((key[0], request, asked, asked + pd.Timedelta(milliseconds=round(wait)), round(wait)))
        self.full.update((full,))
        forget = max(latest + self.idle, int(full) + 1, self.timer.get()[0] if self.timer.exists() else 0)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(forget)
        self.timer.update((forget,))
        yield pd.DataFrame(out, columns=["host", "request_id", "asked", "admitted", "wait_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.full.clear()
        self.timer.clear()
        yield pd.DataFrame(columns=["host", "request_id", "asked", "admitted", "wait_ms"])

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, rate: float = RATE, burst: int = BURST, idle_s: int = IDLE_S) -> DataFrame:
    """When each request (host, request_id, asked) may go: a bucket of ``burst`` tokens for each host, refilled at ``rate`` a second of event time.

    Requests of a host are served in order of time within a trigger; the state
    is one number a host, and a timer drops it once event time is ``idle_s``
    past its last request and the bucket is full again. Needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    marked = requests.select("host", "request_id", "asked").withWatermark("asked", "0 seconds")
    return marked.groupBy("host").transformWithStateInPandas(_Buckets(rate, burst, idle_s), ADMITTED, "update", "eventTime")
