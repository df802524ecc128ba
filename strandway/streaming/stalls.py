"""Operations that stall, found on a stream of their signs of life by timers on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "id string, name string, what string, at long, running long, idle long, stalled boolean"
STATE = "name string, start long, alive long, stalled boolean"


class Watch(StatefulProcessor):
    """State is one open operation an id; a timer is set for the moment from which it counts as stalled."""

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", STATE)

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(old[0]) if isinstance(old, tuple) else int(old))
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at", "rank"], kind="stable")
        now = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for r in found.itertuples():
            if r.kind == "start":
                now = (r.name, int(r.at), int(r.at), False) if now is None else now
            elif now is not None and r.at >= now[1]:
                if r.kind == "end":
                    out.append((key[0], now[0], "ended", int(r.at), int(r.at) - now[1], int(r.at) - now[2], now[3]))
                    now = None
                elif r.at >= now[2]:
                    now = (now[0], now[1], int(r.at), False)
        if now is None:
            self.open.clear()
            self._timer(None)
        else:
            self.open.update(now)
            self._timer(None if now[3] else now[2] + self.threshold)
        yield pd.DataFrame(out, columns=["id", "name", "what", "at", "running", "idle", "stalled"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            name, start, alive, stalled = self.open.get()
            at = int(expiredTimerInfo.getExpiryTimeInMs())
            if not stalled and at >= alive + self.threshold:
                out.append((key[0], name, "stalled", at, at - start, at - alive, True))
                self.open.update((name, start, alive, True))
        yield pd.DataFrame(out, columns=["id", "name", "what", "at", "running", "idle", "stalled"])

    def close(self) -> None:
        pass


def stalls(signs: DataFrame, threshold: int, late: str = "0 seconds") -> DataFrame:
    """id, name, what (``stalled`` or ``ended``), at, running, idle, stalled for a stream of id, name, kind, time.

    kind is start, update or end; times in the result are milliseconds. An operation that gives no sign for
    ``threshold`` ms is reported once, at that moment of event time, as soon as the watermark (``late`` behind the
    stream) passes it; a later update makes it fit for another report, and its end says whether a stall was open.
    Signs of an operation that isn't open, and null ids, are left out; a second start goes on with the first. State of
    an operation goes with its end. Needs the RocksDB state store.
    """
    ms = F.unix_millis(F.col("time"))
    rank = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "update", 1).otherwise(2)
    given = signs.where("id IS NOT NULL AND time IS NOT NULL").withWatermark("time", late)
    given = given.select(F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name"), "kind", ms.alias("at"), rank.alias("rank"), "time")
    return given.groupBy("id").transformWithStateInPandas(Watch(threshold), OUT, "Append", "EventTime")


def operation_statistics(ended: DataFrame, name: str, seconds: str, order: list[str]) -> DataFrame:
    """name, count, total_time, max_time, last_time (of the last in ``order``), avg_time of finished operations."""
    return ended.groupBy(name).agg(
        F.count("*").alias("count"), F.sum(seconds).alias("total_time"), F.max(seconds).alias("max_time"), F.max_by(seconds, F.struct(*order)).alias("last_time"), F.avg(seconds).alias("avg_time")
    )
