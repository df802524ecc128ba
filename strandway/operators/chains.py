"""A chain of row operators in which a failing row goes to a side table and the rest goes on.

A step is a function from a pandas batch to a pandas batch: it may change, drop or repeat rows. A batch that a step
fails on is halved until the rows that it can't take are alone; those leave the chain with the step's name and the
reason, the others go on as batches. All is one pass over the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandway.sources.stages import kept

Step = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass
class Outcome:
    """What the chain gave: rows, quarantine (step, reason, row as JSON) and counts by name."""

    rows: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def attempted(step: Step, batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame | None, str, pd.DataFrame]]:
    """(result, "", batch) of the parts that a step takes, (None, reason, row) of the rows that it fails on, in order."""
    if not len(batch):
        return
    try:
        result = step(batch.copy())
        if not isinstance(result, pd.DataFrame):
            raise TypeError(f"a step gives a batch, not {type(result).__name__}")
    except Exception as e:
        if len(batch) == 1:
            yield None, f"{type(e).__name__}: {e}", batch
        else:
            half = len(batch) // 2
            yield from attempted(step, batch.iloc[:half])
            yield from attempted(step, batch.iloc[half:])
    else:
        yield result, "", batch


def chained(df: DataFrame, steps: list[tuple[str, Step]], schema: str) -> Outcome:
    """Apply the named steps in turn. ``schema`` is that of the last step's batches.

    A row that the last step gives but that doesn't fit the schema fails as step ``schema``. Steps see a batch with a
    fresh index. A null result of a whole chain (all rows dropped) is an empty table.
    """
    names = [f.split()[0].strip("`") for f in schema.split(",")]
    bad = ["_step", "_reason", "_row"]

    def fits(batch: pd.DataFrame) -> pd.DataFrame:
        if missing := [c for c in names if c not in batch.columns]:
            raise KeyError(f"no column {missing[0]}")
        import pyarrow as pa

        for c, kind in kinds.items():
            pa.Array.from_pandas(batch[c], type=kind)
        return batch[names]

    from pyspark.sql.pandas.types import to_arrow_type

    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, lost = [batch], []
            for name, step in [*steps, ("schema", fits)]:
                next_parts = []
                for part in parts:
                    for result, reason, of in attempted(step, part.reset_index(drop=True)):
                        if result is None:
                            lost.append((name, reason, of.iloc[0].to_json(default_handler=str, force_ascii=False)))
                        else:
                            next_parts.append(result)
                parts = [pd.concat(next_parts, ignore_index=True)] if next_parts else []
            if lost:
                parts.append(pd.DataFrame(lost, columns=bad))
            for part in parts:
                absent = {c: pd.Series([None] * len(part), part.index, object) for c in [*names, *bad] if c not in part.columns}
                yield part.assign(**absent)[[*names, *bad]]

    seen = Observation()
    out = df.mapInPandas(run, f"{schema}, _step string, _reason string, _row string")
    counts = [F.count_if(F.col("_step").isNull()).alias("rows"), F.count_if(F.col("_step").isNotNull()).alias("quarantined")]
    counts += [F.count_if(F.col("_step") == name).alias(f"failed_{name}") for name, _ in [*steps, ("schema", None)]]
    whole = kept(out.observe(seen, *counts), "chained")
    good = whole.where("_step IS NULL").select(*[f"`{c}`" for c in names])
    return Outcome(good, whole.where("_step IS NOT NULL").select(F.col("_step").alias("step"), F.col("_reason").alias("reason"), F.col("_row").alias("row")), seen.get)
