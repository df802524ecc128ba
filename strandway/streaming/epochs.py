"""An endless stream of items in a new order each epoch, which a restart takes up where it stopped.

The order is a keyed permutation of 0 .. n - 1 that is computed for each index, so nothing is sorted or held: a
position is (epoch, index), which is the stream's offset, and any task can make any part of any epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ROUNDS = 6
SCHEMA = pa.schema([("epoch", pa.int64()), ("index", pa.int64()), ("place", pa.int64())])
BATCH = 1 << 16


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """Places of the indices in the epoch's order: a Feistel network on the next even number of bits, walked on until it
    is under n, which keeps it a permutation of 0 .. n - 1."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(epoch % (1 << 32) * 64), np.uint64(seed % (1 << 64)))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right, key) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Span(InputPartition):
    start: int
    stop: int


class EpochReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.n, self.seed = int(options["items"]), int(options.get("seed", 0))
        self.batch, self.tasks = int(options.get("batch", 1024)), int(options.get("tasks", 1))
        self.first = (int(options.get("startepoch", 0)), int(options.get("startindex", 0)))
        self.end = int(options["epochs"]) * self.n if "epochs" in options else None
        if self.n < 1:
            raise ValueError("a stream of epochs needs an item at least")
        self.at: int | None = None

    def _number(self, offset: dict) -> int:
        return int(offset["epoch"]) * self.n + int(offset["index"])

    def _offset(self, number: int) -> dict:
        return {"epoch": number // self.n, "index": number % self.n}

    def initialOffset(self) -> dict:
        return self._offset(self.first[0] * self.n + self.first[1])

    def latestOffset(self) -> dict:
        """One batch past what was planned last; after a restart, past what the checkpoint had planned."""
        now = self._number(self.initialOffset()) if self.at is None else self.at
        self.at = now + self.batch if self.end is None else max(now, min(now + self.batch, self.end))
        return self._offset(self.at)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        a, b = self._number(start), self._number(end)
        self.at = max(b, self.at or 0)
        cuts = [a + (b - a) * i // self.tasks for i in range(self.tasks + 1)]
        return [Span(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        at = partition.start
        while at < partition.stop:
            epoch = at // self.n
            stop = min(partition.stop, (epoch + 1) * self.n, at + BATCH)
            index = np.arange(at, stop) - epoch * self.n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), epoch)), pa.array(index), pa.array(permuted(index, self.n, self.seed, epoch))], schema=SCHEMA)
            at = stop

    def commit(self, end: dict) -> None:
        pass


class EpochSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        return "epoch long, index long, place long"

    def streamReader(self, schema) -> EpochReader:
        return EpochReader(dict(self.options))


def epochs(spark: SparkSession, items: int, seed: int = 0, batch: int = 1024, tasks: int = 1, until: int | None = None, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """A stream of epoch, index and place: in each epoch every place of 0 .. items - 1 once, ``batch`` a micro-batch.

    ``until`` ends it after so many epochs; ``start`` is the epoch and index to begin with where no checkpoint says
    more. A join with a table of items by place gives the items.
    """
    spark.dataSource.register(EpochSource)
    stream = spark.readStream.format("epochs").option("items", items).option("seed", seed).option("batch", batch).option("tasks", tasks).option("startEpoch", start[0]).option("startIndex", start[1])
    return (stream if until is None else stream.option("epochs", until)).load()
