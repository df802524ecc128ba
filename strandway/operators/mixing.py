"""Mixing of sources, replay and the dealing out of rows to ranks and workers, by arithmetic on stable places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.functions.seeds import uniform


def epoch_counts(demos: Column, wins: Column, losses: Column, p_demo: float, p_win: float) -> dict[str, Column]:
    """Demonstrations, successful and failed roll-outs of an epoch, scaled up to the two shares; never scaled down.

    First successes against failures, then demonstrations against both; a share of 0 or 1, or a part without steps,
    leaves the other part as it is. Without roll-outs only demonstrations count.
    """
    whole = lambda x: x.cast("long")
    zero = F.lit(0).cast("long")
    none_won = F.lit(p_win == 0) | (wins == 0)
    only_won = ~none_won & (F.lit(p_win == 1) | (losses == 0))
    share = F.when(none_won, 0.0).when(only_won, 1.0).otherwise(p_win)
    more_won = whole(losses * p_win / (1 - p_win)) if p_win < 1 else zero
    more_lost = whole(wins * (1 - p_win) / p_win) if p_win > 0 else zero
    won = F.when(none_won, zero).when(only_won, wins).otherwise(F.greatest(wins, more_won))
    lost = F.when(none_won, losses).when(only_won, zero).when(wins < more_won, losses).otherwise(more_lost)
    more_demos = whole((won + lost) * p_demo / (1 - p_demo)) if p_demo < 1 else zero
    more_rolled = whole(demos * (1 - p_demo) / p_demo) if p_demo > 0 else zero
    no_demos = F.lit(p_demo == 0) | (demos == 0)
    grow = demos < more_demos
    rolled = (wins + losses) > 0
    only_demos = F.lit(p_demo == 1) & ~no_demos
    return {
        "demos": F.when(~rolled, demos).when(no_demos, zero).when(only_demos, demos).otherwise(F.greatest(demos, more_demos)),
        "wins": F.when(~rolled, zero).when(no_demos, won).when(only_demos, zero).when(grow, won).otherwise(whole(more_rolled * share)),
        "losses": F.when(~rolled, zero).when(no_demos, lost).when(only_demos, zero).when(grow, lost).otherwise(whole(more_rolled * (1 - share))),
    }


def sample_type(index: Column, demos: Column, wins: Column) -> Column:
    return F.when(index < demos, "demo").when(index < demos + wins, "success").otherwise("failure")


def ratio_source(step: Column, ratios: dict[str, int]) -> Column:
    """The source of a global step in a weighted round: the first ratio's share of steps, then the next one's."""
    at, edge, parts = F.pmod(step, F.lit(sum(ratios.values()))), 0, []
    for name, share in ratios.items():
        edge += share
        parts.append(F.when(at < edge, name))
    return F.coalesce(*parts)


def rank_range(length: Column, world: int, rank: Column) -> dict[str, Column]:
    """first, end, overflow of a rank's contiguous range; the first ranks take one row more. A rank without rows takes
    row 0 as an overflow."""
    each, rest = F.floor(length / world), F.pmod(length, F.lit(world))
    first = rank * each + F.least(rank, rest)
    end = first + each + F.when(rank < rest, 1).otherwise(0)
    over = first >= length
    return {"first": F.when(over, 0).otherwise(first).cast("long"), "end": F.when(over, 1).otherwise(end).cast("long"), "overflow": over}


def shard_owner(df: DataFrame, group: list[str], order: list[str], world: int, workers: int) -> DataFrame:
    """rank, worker and turn of each shard: every ``world``-th to a rank, of those every ``workers``-th to a worker."""
    at = F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    d = df.withColumn("_at", at).withColumn("rank", F.col("_at") % world).withColumn("_own", F.floor(F.col("_at") / world))
    return d.withColumn("worker", (F.col("_own") % workers).cast("int")).withColumn("turn", F.floor(F.col("_own") / workers).cast("long")).drop("_at", "_own")


def replayed(df: DataFrame, copies: Column) -> DataFrame:
    """Every row ``copies`` times, with its copy number from 0; no rows for less than one."""
    return df.where(copies >= 1).withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))


def modulo_step(index: Column, steps: Column) -> Column:
    """The step that a sample index replays: index modulo the number of steps."""
    return F.pmod(index, steps)


def auxiliary(df: DataFrame, name: Column, p: float, pool: int) -> DataFrame:
    """auxiliary: with probability ``p`` the place of a row of an auxiliary pool of ``pool`` rows, drawn evenly, else
    null. Draws come from a hash of the name."""
    take = uniform(F.concat(name, F.lit("|take"))) < p
    return df.withColumn("auxiliary", F.when(take, F.floor(uniform(F.concat(name, F.lit("|which"))) * pool)))


def one_of_top(ranked: DataFrame, query: list[str], rank: str, k: int, name: Column, dropout: float) -> DataFrame:
    """One of the first ``k`` rows of each query, drawn evenly among those there are, with dropped where the draw says
    that the match is to be masked. ``name`` is the query's as text."""
    first = ranked.where(F.col(rank) <= k).withColumn("_k", F.count("*").over(W.partitionBy(*query)))
    pick = F.floor(uniform(F.concat(name, F.lit("|pick"))) * F.col("_k")) + 1
    return first.where(F.col(rank) == pick).withColumn("dropped", uniform(F.concat(name, F.lit("|drop"))) < dropout).drop("_k")


def proportional_workers(counts: dict[str, int], workers: int) -> dict[str, int]:
    """At least one worker for each key, each further one to the key that is most under-served; ties to the first. Keys
    are few, so this is plain arithmetic. Fewer workers than keys raise a ValueError."""
    if workers < len(counts):
        raise ValueError("a worker serves one key only")
    total, given = sum(counts.values()), dict.fromkeys(counts, 1)
    for _ in range(workers - len(counts)):
        have = sum(given.values())
        given[min(counts, key=lambda k: given[k] / have - counts[k] / total)] += 1
    return given


def equal_shares(counts: dict[str, int], workers: int) -> tuple[dict[str, int], int]:
    """Items of each key after repeating them so that all workers get as many, and that number. Shares of workers are
    rounded up; the key with the most items takes the difference."""
    total = sum(counts.values())
    shares = {k: -(-n * workers // total) for k, n in counts.items()}
    shares[max(counts, key=counts.get)] += workers - sum(shares.values())
    each = -(-total // sum(shares.values()))
    return {k: s * each for k, s in shares.items()}, each


def url_of_worker(urls: Column, worker: Column, workers: int) -> Column:
    """The places of a worker's items among ``urls`` of them: every ``workers``-th, or one by modulo where there are
    fewer items than workers."""
    own = F.sequence(worker.cast("long"), F.greatest(urls - 1, worker).cast("long"), F.lit(workers).cast("long"))
    return F.when(urls >= workers, own).otherwise(F.array(F.pmod(worker, urls).cast("long")))
