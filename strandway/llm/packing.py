"""Sum-of-squares online packing of documents into token windows.

A map over the texts gives one narrow row for each piece (a document, or a full window or the rest of a longer one),
which is written to the shared folder with a number. Pieces are dealt out by a hash of the number, so no key can be
hot, to as many tasks as keep ``ROWS`` pieces each. A task packs its own in order of (doc_id, start): a piece goes to
the fill level whose change makes the sum of squared counts of partly filled windows least. Windows that end up partly
filled are taken apart, and a second round, again of ``ROWS`` pieces a task, packs their pieces again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandway.llm.tokens import chunk_memo
from strandway.llm.words import plain

#: Pieces that a task packs and holds: 2**16 rows of eight numbers are 4 MB.
ROWS = 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every text: full windows of a longer document, then the rest.

    A null or empty text is the end id alone; null ids and repeated rows have pieces of their own; an empty table
    gives none; other columns, whatever their names, don't matter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = chunk_memo(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), plain(batch.column(1)).to_pylist(), strict=True):
                ids = memo.encode(text) + end
                tokens = len(ids) // 4
                rows += [(key, at, min(window, tokens - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), tokens) for at in range(0, tokens, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, PIECES.replace(" long", "").split(", "))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


class Levels:
    """The level array: how many open windows are filled to each level, and which."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for a piece. Of equal changes the fullest level wins; a new window counts as level 0."""
        if size == self.window:
            self.made += 1
            return self.made - 1, 0
        to = self.count[size : self.window + 1]
        change = 2 * to + 1
        change[-1] = 0  # a full window is no longer open
        have = self.count[: self.window - size + 1]
        change[1:] -= 2 * have[1:] - 1
        change[1:][have[1:] == 0] = np.iinfo(np.int64).max
        level = self.window - size - int(np.argmin(change[::-1]))
        if level:
            own = self.open[level].pop()
            self.count[level] -= 1
        else:
            own, self.made = self.made, self.made + 1
        if level + size < self.window:
            self.open[level + size].append(own)
            self.count[level + size] += 1
        return own, level


def _packed(window: int, round_: int):
    """Packs a task's pieces in order. ``open`` marks the pieces of windows that aren't full."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, base = Levels(window), (round_ << 62) | (TaskContext.get().partitionId() << 32)
        kept = []
        for frame in frames:
            placed = np.array([levels.place(n) for n in frame.length.tolist()], np.int64).reshape(-1, 2)
            frame["own"], frame["offset"] = placed[:, 0], placed[:, 1]
            kept.append(frame)
        left = np.array(sorted(x for level in levels.open for x in level), np.int64)
        for frame in kept:
            frame["open"] = np.isin(frame.own, left)
            frame["sequence_id"] = frame.pop("own") + base
            yield frame

    return pack


def _dealt(rows: DataFrame, salt: int) -> DataFrame:
    """The rows, which must be a staged table, in tasks of about ROWS, each in order."""
    tasks = max(1, -(-rows.count() // ROWS))
    return rows.repartition(tasks, F.xxhash64(F.lit(salt), "nth")).sortWithinPartitions("doc_id", "start", "ids_crc32", "nth").drop("nth")


def pack(pieces_: DataFrame, window: int, stage) -> DataFrame:
    """sequence_id and offset for every piece. ``stage`` writes a DataFrame to the shared folder and reads it back.

    Equal rows are pieces of their own. No pieces give no rows. Sequence ids are unique, not dense.
    """
    schema = f"{PIECES}, offset long, open boolean, sequence_id long"
    numbered = stage(pieces_.withColumn("nth", F.monotonically_increasing_id()), "pieces")
    first = stage(_dealt(numbered, 0).mapInPandas(_packed(window, 0), schema).withColumn("nth", F.monotonically_increasing_id()), "packed")
    again = first.where("open").drop("open", "sequence_id", "offset")
    second = _dealt(again, 1).mapInPandas(_packed(window, 1), schema)
    return first.where("not open").drop("nth").unionByName(second).drop("open")
