"""Flushes of upload sessions as a stream with timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in this store; sessions must name it in ``PROVIDER_KEY``.
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Windows(StatefulProcessor):
    """The open window of a session: its number, its begin, and the containers staged in it, fewer than ``most``."""

    def __init__(self, interval_ms: int, most: int):
        self.interval_ms, self.most = interval_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "flush long, begin long")
        self.staged = handle.getListState("staged", "container long")

    def _row(self, key: tuple, flush: int, begin: int, held: list[int], closed_by: str) -> tuple:
        return key[0], flush, begin, len(held), held, closed_by

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session", "flush", "begin_ms", "n", "containers", "closed_by"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        flush, begin = (int(x) for x in self.at.get()) if self.at.exists() else (0, -1)
        held = [int(c) for (c,) in self.staged.get()] if begin >= 0 else []
        timer, out = begin, []
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "container"])
        for at, container in zip(map(int, batch["ts_ms"]), map(int, batch["container"])):
            if begin >= 0 and at - begin >= self.interval_ms:
                out.append(self._row(key, flush, begin, held, "interval"))
                flush, begin, held = flush + 1, -1, []
            begin = at if begin < 0 else begin
            held.append(container)
            if len(held) == self.most:
                out.append(self._row(key, flush, begin, held, "count"))
                flush, begin, held = flush + 1, -1, []
        if begin != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer + self.interval_ms)
            if begin >= 0:
                self.handle.registerTimer(begin + self.interval_ms)
        self.at.update((flush, begin))
        self.staged.put([(c,) for c in held]) if held else self.staged.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        flush, begin = (int(x) for x in self.at.get())
        out = []
        if begin >= 0 and begin + self.interval_ms <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._row(key, flush, begin, [int(c) for (c,) in self.staged.get()], "interval"))
            self.at.update((flush + 1, -1))
            self.staged.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def flush_stream(made: DataFrame, interval_ms: int = 20_000, most: int = 64, late: str = "10 seconds") -> DataFrame:
    """made(session long, ts timestamp, container long) -> session, flush, begin_ms, n, containers, closed_by: a row for each flush; for append mode.

    The windows are those of ``sessions.flush_windows``: one ends with its ``most``-th
    container at once, or ``interval_ms`` after its first one, when a container of its
    session comes later than that or, by a timer, when the watermark gets there. What is
    staged is state, so a restart from the checkpoint goes on with it. Containers of a
    session arrive in order of time across batches (within one they are put in order);
    those behind the watermark, ``late`` after the newest of all sessions, and those
    without session, time or container are left out.
    """
    rows = made.where("session is not null and ts is not null and container is not null").withWatermark("ts", late)
    rows = rows.select("session", "ts", F.unix_millis("ts").alias("ts_ms"), "container")
    schema = "session long, flush long, begin_ms long, n long, containers array<long>, closed_by string"
    return rows.groupBy("session").transformWithStateInPandas(_Windows(interval_ms, most), schema, "append", "EventTime")
