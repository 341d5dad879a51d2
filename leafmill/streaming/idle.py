"""G2, G5 as a stream whose state is bounded by the books that are being read: an event-time timer clears those that are idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .throttle import DELETED, OUT, _prepared, passes

IDLE_MS = 6 * 3600 * 1000
"""A book without rows for so long is new when it comes again, whether its state is still there or not."""
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Throttle(StatefulProcessor):
    """Of each book the last row kept, and the time of the last row seen; a timer for the time at which it is idle."""

    def __init__(self, rows: int, idle_ms: int):
        self.rows, self.idle_ms = rows, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, line int, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["updated_at", "item_id"], kind="stable")
        held = self.last.get() if self.last.exists() else None
        state, seen = (None, None) if held is None else ((int(held[0]), int(held[1])), int(held[2]))
        keep = []
        for ms, line, reason in zip(pdf["ms"].tolist(), pdf["line_index"].tolist(), pdf["reason"]):
            if seen is not None and ms - seen >= self.idle_ms:
                state = None
            ok = reason != DELETED and passes(ms, line, reason, state, self.rows)
            state = None if reason == DELETED else (ms, line) if ok else state
            seen = None if reason == DELETED else ms if seen is None else max(seen, ms)
            keep.append(ok)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state is None:
            self.last.clear()
        else:
            self.last.update((*state, seen))
            self.handle.registerTimer(seen + self.idle_ms)
        yield pdf.loc[keep, ["book_id", "item_id", "line_index", "updated_at", "reason"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_throttle_idle(feed: DataFrame, rows: int, idle_ms: int = IDLE_MS, delay: str = "1 hour") -> DataFrame:
    """The rows of a progress stream that pass.

    A row of reason `deleted` clears its book's state; so does a timer once the
    watermark, `delay` behind the newest row, is `idle_ms` past a book's last
    row. The rule counts such a book as new by the times alone, so results do
    not hang on when a timer fires. Rows later than the watermark are dropped.
    The session must keep state in RocksDB (`PROVIDER`).
    """
    prepared = _prepared(feed.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", delay))
    return prepared.groupBy("book_id").transformWithStateInPandas(Throttle(rows, idle_ms), OUT, "Append", "EventTime")
