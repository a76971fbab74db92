"""Retries of page captures as keyed state with timers: each URL's failures are counted, and its next try falls due as event time passes.

Input are attempts (url, ts, ok, error). A failed URL falls due again ``delay`` seconds times its failures so far after it failed; after ``retries`` retries it
is given up. The state of a URL is two numbers, gone once it is done or given up, so what is kept grows with what is in flight only. State and
timers are in the checkpoint: a job that is killed goes on with what was due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "url string, attempts int, action string, at timestamp, error string"
#: What keeps state and timers; the session must name it before the stream starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retries(StatefulProcessor):
    def __init__(self, retries: int, delay: float):
        self.retries, self.delay = retries, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n int, due bigint")

    def _clear(self) -> None:
        if self.failures.exists():
            due = self.failures.get()[1]
            if due is not None:
                self.handle.deleteTimer(due)
            self.failures.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "ok"], kind="stable").itertuples():
            n = (self.failures.get()[0] if self.failures.exists() else 0) + 1
            if r.ok:
                self._clear()
                out.append((key[0], n, "done", r.ts, None))
                continue
            self._clear()
            if n > self.retries:
                out.append((key[0], n, "give_up", r.ts, r.error))
            else:
                due = int(r.ts.timestamp() * 1000 + self.delay * 1000 * n)
                self.handle.registerTimer(due)
                self.failures.update((n, due))
        yield pd.DataFrame(out, columns=["url", "attempts", "action", "at", "error"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self.failures.exists() and self.failures.get()[1] == due:
            n = self.failures.get()[0]
            self.failures.update((n, None))
            out.append((key[0], n, "retry", pd.Timestamp(due, unit="ms"), None))
        yield pd.DataFrame(out, columns=["url", "attempts", "action", "at", "error"])

    def close(self) -> None:
        pass


def decisions(attempts: DataFrame, retries: int = 2, delay: float = 1.0, late: str = "0 seconds") -> DataFrame:
    """SRC19: (url, attempts, action, at, error): retry once it is due, done, or give_up with the last error."""
    keyed = attempts.select("url", "ts", "ok", "error").withWatermark("ts", late).groupBy("url")
    return keyed.transformWithStateInPandas(statefulProcessor=Retries(retries, delay), outputStructType=OUT, outputMode="Append", timeMode="eventTime")
