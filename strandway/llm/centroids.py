"""Centroid clustering in exact integers, with Hamerly's bounds.

Each vector keeps, in a table of the shared folder, the upper bound of the distance to its own centroid and the lower
bound of the distance to the second nearest. When centroids move, the bounds are loosened by how far they moved. A
vector whose upper bound is under its lower bound, or under half the way from its centroid to the next one, keeps its
centroid unseen; the others get their own distance afresh, and those still in doubt a full scan of all centroids.

Distances of a scan are exact integers. Bounds are doubles with ``SLACK`` added on the safe side, and only a strict
"under" spares a scan, so ties are always settled by a scan, to the smaller number. Sums of the centroids follow the
vectors that changed sides, so a later round aggregates only those. A round reads the table of the one before and
writes its own without a shuffle of vectors; what meets on the driver is the centroids and their sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandway.llm.scratch import clear

#: Largest size of a component, so that a squared distance of 64 components stays under 2^62 (dims scale it).
LARGEST = 1 << 27
#: Relative room that covers the rounding of a square root and a few sums.
SLACK = 1e-12
#: Distances held at once in a scan.
TILE = 1 << 20
STATE = "vec_id long, v array<int>, was int, cluster int, upper double, second double, distance long, scanned boolean"


def kept(vectors: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the components' floor(scale * x), of the vectors with ``dims`` components, none null or not finite.

    Null ids and repeated rows stay; other columns go. A component beyond ``LARGEST`` is an error.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * float(scale)))
    far = F.exists(whole, lambda c: F.abs(c) > LARGEST)
    said = F.lit(f"a component is beyond {LARGEST} once scaled; its squared distances could leave 64 bits")
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.when(far, F.raise_error(said)).otherwise(whole.cast("array<int>")).alias("v"))


def starts(vectors: DataFrame, k: int, salt: str = "1:") -> np.ndarray:
    """The k vectors of the smallest lowercase-hex sha256 of salt and id, in that order; fewer, if there are fewer.

    Rows that repeat an id follow by their components; rows without an id come last.
    """
    drawn = vectors.select("v", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("draw"))
    rows = drawn.orderBy(F.asc_nulls_last("draw"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _lengths(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def _gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the next one, on the safe side."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2).astype(np.float64)
    np.fill_diagonal(apart, np.inf)
    return np.sqrt(apart.min(1)) / 2 * (1 - SLACK)


def assigned(
    rows: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, second: np.ndarray, moved: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, second, scanned) of integer vectors after the centroids moved by at most ``moved``.

    A cluster of -1 has no bounds yet.
    """
    k = len(centroids)
    fresh = cluster < 0
    cluster, own = cluster.copy(), np.maximum(cluster, 0)
    upper = np.where(fresh, np.inf, upper + moved[own] * (1 + SLACK)) * (1 + SLACK)
    # the second nearest can be any other centroid, so the longest way among the others counts
    longest = int(np.argmax(moved))
    others = np.full(k, moved[longest])
    others[longest] = np.delete(moved, longest).max(initial=0.0)
    second = np.where(fresh, -np.inf, second - others[own] * (1 + SLACK))
    second = second * np.where(second > 0, 1 - SLACK, 1 + SLACK)
    bound = np.where(fresh, -np.inf, np.maximum(second, _gaps(centroids)[own]))
    doubt = np.flatnonzero(~(upper < bound))
    if len(doubt):
        near = _lengths(((rows[doubt] - centroids[own[doubt]]) ** 2).sum(1)) * (1 + SLACK)
        upper[doubt] = np.where(fresh[doubt], np.inf, near)
        doubt = doubt[~(upper[doubt] < bound[doubt])]
    step = max(1, TILE // (k * max(1, rows.shape[1])))
    for i in range(0, len(doubt), step):
        at = doubt[i : i + step]
        squared = ((rows[at][:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        best = squared.argmin(1)  # the first of equal ones
        nearest = squared[np.arange(len(at)), best]
        squared[np.arange(len(at)), best] = np.iinfo(np.int64).max
        cluster[at], upper[at] = best, _lengths(nearest) * (1 + SLACK)
        second[at] = _lengths(squared.min(1)) * (1 - SLACK) if k > 1 else np.inf
    scanned = np.zeros(len(rows), bool)
    scanned[doubt] = True
    return cluster, upper, second, scanned


def _step(dims: int, centroids: np.ndarray, moved: np.ndarray, final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            was, upper, second = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "second"))
            cluster, upper, second, scanned = assigned(rows, centroids, was.astype(np.int64), upper.astype(float), second.astype(float), moved)
            distance = ((rows - centroids[cluster]) ** 2).sum(1) if final else np.zeros(len(rows), np.int64)
            cells = [batch.column("vec_id"), batch.column("v"), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), *map(pa.array, (upper, second, distance, scanned))]
            yield pa.RecordBatch.from_arrays(cells, ["vec_id", "v", "was", "cluster", "upper", "second", "distance", "scanned"])

    return run


def _changes(state: DataFrame, dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How sums and counts of the clusters change by the vectors that changed sides: k rows of a partial aggregate."""
    sides = F.array(F.struct(F.col("was").alias("c"), F.lit(-1).alias("by")), F.struct(F.col("cluster").alias("c"), F.lit(1).alias("by")))
    went = state.where("was <> cluster").select("v", F.inline(sides)).where("c >= 0")
    sums = [F.sum(F.col("v")[i].cast("long") * F.col("by")).alias(f"s{i}") for i in range(dims)]
    total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in went.groupBy("c").agg(F.sum("by").cast("long").alias("n"), *sums).collect():
        total[r[0]], count[r[0]] = r[2:], r[1]
    return total, count


def cluster(
    vectors: DataFrame, k: int, rounds: int, stage: Callable[[DataFrame, str], DataFrame], dims: int = 64, scale: float = 64, salt: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scanned for every kept vector.

    Every one of the ``rounds`` gives each vector the nearest centroid (of equal ones the smaller number), then moves
    each centroid that has vectors to their componentwise floor(sum / count). At last vectors are given once more.
    ``scanned`` says whether that last time took a full scan.

    Vectors that ``kept`` leaves out have no row, and an empty table gives none; with fewer than k vectors there are as
    many centroids. Null ids and repeated rows are vectors of their own. Other columns don't matter. A sum that leaves
    64 bits is an error.
    """
    spark = vectors.sparkSession
    state = stage(kept(vectors, dims, scale, id_col, vector_col), "vectors")
    centroids = starts(state, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned boolean")
    k = len(centroids)
    before, moved = state, np.zeros(k)
    state = state.select("vec_id", "v", F.lit(-1).alias("was"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("second"), F.lit(0).cast("long").alias("distance"), F.lit(False).alias("scanned"))
    total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for i in range(rounds + 1):
        state = stage(state.mapInArrow(_step(dims, centroids, moved, i == rounds), STATE), f"round_{i}")
        clear(before)
        before = state
        if i < rounds:
            more, of = _changes(state, dims, k)
            total, count = total + more, count + of
            new = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
            moved, centroids = _lengths(((new - centroids) ** 2).sum(1)) * (1 + SLACK), new
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # k rows
    own, whole = {r.cluster: r.d for r in inertia}, sum(r.d for r in inertia)
    facts = [(c, own.get(c, 0), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
