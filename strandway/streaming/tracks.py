"""Retrieval with memory over streams of queries: scores that build up from step to step of an episode.

The pool is a table; distances of a step come from an ordinary join with it. What is stateful is one recursion per
(episode, demo): its state is the scores of that demo's chunks at the last step, so state is spread over the cluster
by episode and demo and is as long as one demo. A new episode is a new key and so starts afresh.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandway.operators.selection import top_k

SCORES = "episode string, step long, demo string, t long, score double"


def advance(before: dict[int, float] | None, t: np.ndarray, d: np.ndarray, gamma: float, switch_cost: float, chunk: int) -> np.ndarray:
    """Scores of one step: the distance at first; then the lesser of going on from the chunk before and a fresh start."""
    if before is None:
        return d
    last = np.array([before.get(int(x) - chunk, np.inf) for x in t])
    return np.minimum(gamma * last + (1 - gamma) * d, d + switch_cost)


def cumulative_scores(distances: DataFrame, gamma: float, switch_cost: float, chunk: int, idle: int | None = None) -> DataFrame:
    """episode, step, demo, t, score for a stream of episode, step, demo, t, distance (a squared distance).

    A step's rows come in one micro-batch (else take ``cumulative_scores_of_split_steps``), and steps of an episode in
    order; rows of a step already passed are left out, so a batch that is replayed does no harm. ``idle`` is the processing time after which an episode's state goes,
    in milliseconds; without it, state stays.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, before = -1, None
        if state.exists:
            at, ts, scores = state.get
            before = dict(zip(ts, scores, strict=True))
        rows = pd.concat(list(frames)).drop_duplicates(["step", "t"])
        for step, part in rows[rows.step > at].sort_values(["step", "t"]).groupby("step"):
            part = part.assign(score=advance(before, part.t.to_numpy(), part.distance.to_numpy(np.float64), gamma, switch_cost, chunk))
            at, before = int(step), dict(zip(part.t.tolist(), part.score.tolist(), strict=True))
            yield part[["episode", "step", "demo", "t", "score"]]
        if before is not None:
            state.update((at, list(before), list(before.values())))
            if idle:
                state.setTimeoutDuration(idle)

    given = distances.select(F.col("episode").cast("string"), F.col("step").cast("long"), F.col("demo").cast("string"), F.col("t").cast("long"), F.col("distance").cast("double"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return given.groupBy("episode", "demo").applyInPandasWithState(run, SCORES, "at long, t array<long>, score array<double>", "append", timeout)


HELD = "at long, t array<long>, score array<double>, step long, held_t array<long>, held_d array<double>"


def cumulative_scores_of_split_steps(distances: DataFrame, gamma: float, switch_cost: float, chunk: int, idle: int) -> DataFrame:
    """``cumulative_scores`` for streams in which a step's rows may come in several micro-batches.

    A step is held in the state until a row of a later step of its episode and demo comes, or until nothing has come for
    ``idle`` milliseconds of processing time, which ends the episode. A row that is sent again counts once; rows of a
    step that has been given out are left out. State is the scores of one step and the rows of the next.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, before, step, held = -1, None, -1, {}
        if state.exists:
            at, ts, scores, step, held_t, held_d = state.get
            before = dict(zip(ts, scores, strict=True)) if at >= 0 else None
            held = dict(zip(held_t, held_d, strict=True))
        steps = {step: held} if held else {}
        if not state.hasTimedOut:
            for frame in frames:
                for r in frame[frame.step > at].itertuples():
                    steps.setdefault(int(r.step), {}).setdefault(int(r.t), float(r.distance))
        last = max(steps, default=-1)
        for n in sorted(steps):
            if n == last and not state.hasTimedOut:
                break
            t = np.array(sorted(steps[n]), np.int64)
            score = advance(before, t, np.array([steps[n][x] for x in t]), gamma, switch_cost, chunk)
            at, before = n, dict(zip(t.tolist(), score.tolist(), strict=True))
            yield pd.DataFrame({"episode": key[0], "step": n, "demo": key[1], "t": t, "score": score})
        if state.hasTimedOut:
            state.remove()
        elif steps:
            own = before or {}
            state.update((at, list(own), list(own.values()), last, list(steps[last]), list(steps[last].values())))
            state.setTimeoutDuration(idle)

    given = distances.select(F.col("episode").cast("string"), F.col("step").cast("long"), F.col("demo").cast("string"), F.col("t").cast("long"), F.col("distance").cast("double"))
    return given.groupBy("episode", "demo").applyInPandasWithState(run, SCORES, HELD, "append", GroupStateTimeout.ProcessingTimeTimeout)


def best_demos(scores: DataFrame, n: int) -> DataFrame:
    """episode, step, demo, t, score, rank: the ``n`` demos of least score at each step, each at its best chunk."""
    best = scores.groupBy("episode", "step", "demo").agg(F.min(F.struct("score", "t")).alias("b"))
    return top_k(best.select("episode", "step", "demo", "b.t", "b.score"), ["episode", "step"], [F.col("score"), F.col("demo")], n)


TRACKS = "episode string, step long, rank int, demo string, t long, followed boolean"


def follow(tracks: list[tuple[str, int] | None], best: list[tuple[float, str, int]], close: set[tuple[str, int]], chunk: int) -> list[tuple[str, int, bool]]:
    """demo, t and whether it was followed, for each track after one step. A track goes on to the chunk after its own
    where that is close; else it takes the nearest chunk of a demo that no other track is on, or the nearest of all
    where there is none. ``best`` has each demo's nearest chunk, nearest first."""
    now, out = list(tracks), []
    for rank, own in enumerate(tracks):
        if own is not None and (own[0], own[1] + chunk) in close:
            now[rank], followed = (own[0], own[1] + chunk), True
        else:
            taken = {o[0] for i, o in enumerate(now) if i != rank and o is not None}
            _, demo, t = next((b for b in best if b[1] not in taken), best[0])
            now[rank], followed = (demo, t), False
        out.append((*now[rank], followed))
    return out


def consistent_tracks(distances: DataFrame, tracks: int, threshold: float, chunk: int, idle: int | None = None) -> DataFrame:
    """episode, step, rank, demo, t, followed for a stream of episode, step, demo, t, distance (a squared distance):
    ``tracks`` tracks an episode, each kept while its next chunk is within ``threshold``; ties go to the lesser demo and
    t. Track 0 is the one to act on.

    A step's rows come in one micro-batch, and steps of an episode in order; those of a step already passed are left
    out. Of a step's rows a task holds each demo's nearest one and those within the threshold; state is the tracks.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, demos, ts = state.get if state.exists else (-1, [], [])
        now = list(zip(demos, ts, strict=True)) or [None] * tracks
        best: dict[int, dict[str, tuple[float, int]]] = {}
        close: dict[int, set[tuple[str, int]]] = {}
        for frame in frames:
            rows = frame[(frame.step > at) & frame.distance.notna()]
            for r in rows.sort_values(["distance", "t"]).drop_duplicates(["step", "demo"]).itertuples():
                of = best.setdefault(int(r.step), {})
                of[r.demo] = min(of.get(r.demo, (np.inf, 0)), (r.distance, int(r.t)))
            for r in rows[rows.distance <= threshold].itertuples():
                close.setdefault(int(r.step), set()).add((r.demo, int(r.t)))
        out = []
        for step in sorted(best):
            found = follow(now, sorted((d, demo, t) for demo, (d, t) in best[step].items()), close.get(step, set()), chunk)
            now, at = [(demo, t) for demo, t, _ in found], step
            out += [(key[0], step, rank, *f) for rank, f in enumerate(found)]
        if out:
            state.update((at, [d for d, _ in now], [t for _, t in now]))
            if idle:
                state.setTimeoutDuration(idle)
            yield pd.DataFrame(out, columns=["episode", "step", "rank", "demo", "t", "followed"])

    given = distances.select(F.col("episode").cast("string"), F.col("step").cast("long"), F.col("demo").cast("string"), F.col("t").cast("long"), F.col("distance").cast("double"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return given.groupBy("episode").applyInPandasWithState(run, TRACKS, "at long, demo array<string>, t array<long>", "append", timeout)
