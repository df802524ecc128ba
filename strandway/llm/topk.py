"""Exact top-k search by distributed histogram selection.

Queries and candidates are cut into blocks by a hash, and every query block meets every candidate block in a task of
its own (a cogroup on the two block numbers), which scores all its pairs. A first pass counts scores into a histogram
per query; the bin that holds the k-th score becomes the range of the next pass, until few enough rows lie above it.
A last pass keeps the rows at or above that bin and ranks them by (score, id). Ranges are a table too: nothing is
collected, and the number of jobs depends on the range of scores, not on the number of queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries of a block; candidates of a block at most and at least, and blocks wanted in between; bins of a histogram;
#: scores held at once.
QUERIES, MOST, LEAST, WANTED, BINS, TILE = 4096, 1 << 16, 1 << 10, 64, 1024, 1 << 21
_EXACT = float(2**53)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as a matrix, padded with zeros."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _tiles(candidates: pa.Table, queries: pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores of all queries against them, which are the query's own) for tiles of TILE scores."""
    ids, own = (t.column("vec_id").to_numpy() for t in (queries, candidates))
    asked, rows = _matrix(queries.column("e"), width), _matrix(candidates.column("e"), width)
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(asked).max(initial=0)) * width < _EXACT
    if exact:  # in doubles every product and sum is then an exact integer
        asked, rows = asked.astype(np.float64), rows.astype(np.float64)
    step = max(1, TILE // max(1, len(ids)))
    for i in range(0, len(own), step):
        scores = asked @ rows[i : i + step].T
        yield own[i : i + step], scores.astype(np.int64), ids[:, None] == own[None, i : i + step]


def _histograms(k: int, width: int):
    """One task's share of the histograms. Bins below the task's own k-th score can't hold the k-th of all rows."""

    def count(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, low, step = (queries.column(c).to_numpy() for c in ("vec_id", "low", "step"))
        hist = np.zeros((len(ids), BINS), np.int64)
        for _, scores, mine in _tiles(candidates, queries, width):
            at = (scores - low[:, None]) // step[:, None]
            use = (at >= 0) & ~mine
            at = np.minimum(at, BINS - 1) + np.arange(len(ids))[:, None] * BINS
            hist += np.bincount(at[use], minlength=hist.size).reshape(hist.shape)
        above = np.cumsum(hist[:, ::-1], 1)[:, ::-1] - hist
        query, bin_ = np.nonzero((hist > 0) & (above < k))
        return pa.table({"vec_id": pa.array(ids[query], pa.int64()), "bin": pa.array(bin_, pa.int32()), "n": pa.array(hist[query, bin_], pa.int64())})

    return count


def _selected(k: int, width: int):
    """The rows at or above the located bin; of one tile at most k for a query, the best by (score, id)."""

    def pick(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, low = (queries.column(c).to_numpy() for c in ("vec_id", "low"))
        found = [np.zeros((0, 3), np.int64)]
        for own, scores, mine in _tiles(candidates, queries, width):
            query, row = np.nonzero((scores >= low[:, None]) & ~mine)
            score, vec = scores[query, row], own[row]
            order = np.lexsort((vec, -score, query))
            query, score, vec = query[order], score[order], vec[order]
            best = np.arange(len(query)) - np.searchsorted(query, query) < k
            found.append(np.stack([ids[query], vec, score], 1)[best])
        every = np.concatenate(found)
        return pa.table({c: pa.array(every[:, i], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return pick


def exact_topk(
    vectors: DataFrame, is_query: Column, stage: Callable[[DataFrame, str], DataFrame], k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` selects, the ``k`` other rows of the highest
    inner product of floor(scale * component), ties to the smaller id.

    Null ids, null vectors and vectors with a null or non-finite component take no part. A shorter vector counts as
    padded with zeros. Repeated ids are rows of their own as candidates and one query, with the least of their vectors;
    rows of the query's own id are no candidates. Other columns don't matter. An empty table gives no rows. Vectors so
    long that a score could leave 64 bits raise a ValueError.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    fit = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)) & ~F.isnan(c.cast("double")))
    floors = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    norm2 = F.aggregate(F.transform(x, lambda c: F.pow(c.cast("double") * scale, F.lit(2.0)) + F.abs(c.cast("double") * scale) * 2 + 1), F.lit(0.0), lambda s, c: s + c)
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fit).select(F.col(id_col).cast("long").alias("vec_id"), floors.cast("array<long>").alias("e"), norm2.alias("norm2"), is_query.alias("asked"))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("width"), F.max("norm2").alias("norm2"), F.count_if("asked").alias("asked")).first()
    if not shape.asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if shape.norm2 >= 2.0**62:
        raise ValueError("vectors too long: inner products could leave 64 bits")
    width = max(1, shape.width)
    q_blocks = -(-shape.asked // QUERIES)
    c_blocks = -(-shape.n // min(MOST, max(LEAST, shape.n // WANTED)))
    reach = F.ceil(F.sqrt(F.col("norm2")) * math.sqrt(shape.norm2) * (1 + 1e-12)).cast("long") + 1
    own = rows.where("asked").groupBy("vec_id").agg(F.min(F.struct("e", "norm2")).alias("v")).select("vec_id", "v.*")
    state = own.select("vec_id", "e", (-reach).alias("low"), (F.floor(2 * reach / BINS).cast("long") + 1).alias("step"), F.lit(True).alias("open"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("q"))
    state = stage(state, "queries")

    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    deal = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(c_blocks)).alias("c")
    candidates = rows.select("vec_id", "e", deal).withColumn("q", F.explode(upto(q_blocks)))

    def met(queries: DataFrame, task: Callable, schema: str) -> DataFrame:
        dealt = queries.select("vec_id", "e", "low", "step", "q", F.explode(upto(c_blocks)).alias("c"))
        return candidates.groupBy("q", "c").cogroup(dealt.groupBy("q", "c")).applyInArrow(task, schema)

    down = W.partitionBy("vec_id").orderBy(F.desc("bin"))
    while not state.where("open").isEmpty():
        hist = met(state.where("open"), _histograms(k, width), "vec_id long, bin int, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        heads = hist.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") - F.col("n") < k)
        kth = heads.groupBy("vec_id").agg(F.min("bin").alias("bin"), F.max("upto").alias("upto"))
        found = state.join(kth, "vec_id", "left")
        again = F.coalesce(F.col("open") & (F.col("upto") > 8 * k) & (F.col("step") > 1), F.lit(False))
        low = F.col("low") + F.when(F.col("open"), F.coalesce(F.col("bin"), F.lit(0)) * F.col("step")).otherwise(0)
        step = F.when(again, F.floor(F.col("step") / BINS).cast("long") + 1).otherwise(F.col("step"))
        state = stage(found.select("vec_id", "e", low.alias("low"), step.alias("step"), again.alias("open"), "q"), "queries")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met(state, _selected(k, width), "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
