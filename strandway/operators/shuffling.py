"""A bounded shuffle buffer: rows of a task leave in a drawn order, with ``size`` rows and a batch held at a time.

A row's draw is a hash of the seed, the epoch and what identifies the row, so a task that is run again gives the same
order, and another epoch another one. The buffer is filled first; then each row that comes in takes the slot of its
draw and the row that was there leaves; at the end the rest leaves by a second draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exchanged(slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(who leaves, who stays) when rows come to the slots of a full buffer one after the other.

    Rows are numbered with those of the buffer first. Who leaves for a row is the one that came to its slot last.
    """
    coming = np.arange(len(slots)) + size
    order = np.argsort(slots, kind="stable")
    sorted_slots = slots[order]
    first = np.ones(len(slots), bool)
    first[1:] = sorted_slots[1:] != sorted_slots[:-1]
    leaves = np.empty(len(slots), np.int64)
    leaves[order] = np.where(first, sorted_slots, np.concatenate([[0], coming[order][:-1]])[: len(slots)])
    stays = np.arange(size)
    stays[slots] = coming  # the last one to come counts
    return leaves, stays


def shuffled(df: DataFrame, identity: list[str], size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """The rows of ``df``, each task's in a new order. ``identity`` names the columns that tell rows apart.

    Rows that agree in them share a draw. A task with ``size`` rows or fewer is shuffled as a whole; an empty one stays.
    """
    names = df.columns
    draws = [F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(turn), *identity) for turn in (0, 1)]
    given = df.select("*", *[d.alias(f"_draw{i}") for i, d in enumerate(draws)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            coming = pa.Table.from_batches([batch])
            if held is None or held.num_rows < size:
                room = size - (held.num_rows if held is not None else 0)
                part = coming.slice(0, room)
                held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
                coming = coming.slice(room)
            if coming.num_rows:
                slots = (coming.column(len(names)).to_numpy().astype(np.uint64) % np.uint64(size)).astype(np.int64)
                leaves, stays = exchanged(slots, size)
                both = pa.concat_tables([held, coming])
                yield from both.take(pa.array(leaves)).select(names).combine_chunks().to_batches()
                held = both.take(pa.array(stays)).combine_chunks()
        if held is not None and held.num_rows:
            last = np.argsort(held.column(len(names) + 1).to_numpy(), kind="stable")
            yield from held.take(pa.array(last)).select(names).combine_chunks().to_batches()

    return given.mapInArrow(run, df.schema)
