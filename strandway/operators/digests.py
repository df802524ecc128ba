"""Content hashes of ordered rows as trees of blocks, so that one long key is hashed by all tasks.

A row's hash covers its cells, each with its length in front, so no two lists of cells read alike. A block's hash
covers the hashes of ``block`` consecutive rows, and those of blocks are joined likewise until one remains. The hash of
a key covers that and its number of rows. Blocks can be kept: rows that are appended change the blocks from the one in
which they begin, and ``roots`` of old and new blocks is the hash of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandway.operators.ordering import numbered

BLOCK = 64


def row_hash(columns: list[Column]) -> Column:
    """sha256 of the cells as text, each ``-`` if null, else its byte count, a colon and the text."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def blocks(df: DataFrame, keys: list[str], order: list[str], columns: list[str], block: int = BLOCK) -> DataFrame:
    """keys, idx, rows, sha256: the hash of each block of ``block`` consecutive rows of a key; the last may be shorter."""
    rows = df.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], row_hash([F.col(c) for c in columns]).alias("_h"))
    placed = numbered(rows, keys, [f"_o{i}" for i in range(len(order))])
    own = F.sort_array(F.collect_list(F.struct("pos", "_h")))  # ``block`` rows at most
    made = placed.groupBy(*keys, F.expr(f"pos div {block}").alias("idx")).agg(F.count("*").alias("rows"), own.alias("_l"))
    return made.select(*keys, "idx", "rows", F.sha2(F.array_join(F.col("_l._h"), ""), 256).alias("sha256"))


def roots(made: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, rows, sha256 of the key's whole content, of its blocks."""
    most = made.agg(F.max("idx")).first()[0]
    level = made
    while most:  # so many levels as the longest key has; in shorter ones a lone node is passed on as it is
        up = level.groupBy(*keys, F.expr(f"idx div {block}").alias("_up")).agg(F.sum("rows").alias("rows"), F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("idx", "sha256"))).alias("_l"))
        alone = (F.col("_up") == 0) & (F.col("_n") == 1)
        level = up.select(*keys, F.col("_up").alias("idx"), "rows", F.when(alone, F.col("_l")[0]["sha256"]).otherwise(F.sha2(F.array_join(F.col("_l.sha256"), ""), 256)).alias("sha256"))
        most //= block
    return level.select(*keys, "rows", F.sha2(F.concat(F.col("rows").cast("string"), F.lit(":"), "sha256"), 256).alias("sha256"))


def content_hash(df: DataFrame, keys: list[str], order: list[str], columns: list[str], block: int = BLOCK) -> DataFrame:
    """keys, rows, sha256 of each key's rows in ``order``, which has to be total within a key."""
    return roots(blocks(df, keys, order, columns, block), keys, block)


def derived(frames: DataFrame, keys: list[str], order: list[str], allowed: list[str], given: list[str], before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, episodes): the ``allowed`` columns of the frames, and keys, rows, content_sha256, source_sha256, status.

    ``content_sha256`` covers what is passed on, ``source_sha256`` the columns ``given``. With ``before``, the episodes
    of an earlier run, an episode is ``reused`` where its source is the same and ``changed`` where it isn't, and rows
    are those of ``converted`` episodes only. A column that is asked for but not in the frames is an error.
    """
    if unknown := [c for c in [*keys, *order, *allowed, *given] if c not in frames.columns]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    own = content_hash(frames, keys, order, allowed).withColumnRenamed("sha256", "content_sha256")
    source = content_hash(frames, keys, order, given).select(*keys, F.col("sha256").alias("source_sha256"))
    episodes = own.join(source, keys)
    if before is None:
        return frames.select(*dict.fromkeys([*keys, *order, *allowed])), episodes.withColumn("status", F.lit("converted"))
    old = before.select(*keys, F.col("source_sha256").alias("_old"))
    status = F.when(F.col("_old").isNull(), "converted").when(F.col("_old") == F.col("source_sha256"), "reused").otherwise("changed")
    episodes = episodes.join(old, keys, "left").withColumn("status", status).drop("_old")
    rows = frames.join(episodes.where("status = 'converted'").select(*keys), keys, "left_semi")
    return rows.select(*dict.fromkeys([*keys, *order, *allowed])), episodes
