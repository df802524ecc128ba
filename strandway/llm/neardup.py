"""MinHash near-duplicates by a multi-index Hamming join.

Signatures are b-bit minima. Their positions are split into ``CHUNKS`` chunks; as two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` positions have a chunk with at most ``ERRORS`` differing ones (pigeonhole), each chunk is
indexed under the keys that remain when any ``ERRORS`` of its positions are left out. So every pair under that distance
shares a key, and that distance is the most that ``far`` allows: no pair under the signature-distance threshold is lost.
A pair whose sets are just at the threshold has signatures over it with probability 2.4e-8 at a similarity of 0.85 and
5.2e-7 at 0.80.

Equal sets are one class, represented by its least id, before any key is made. No pairs are made from a key's group.
Each class is first compared with the hub of its key, the least class there, by signatures. A key whose classes are
all near the hub needs no more; of the others all classes meet in tasks, by signatures again, a hot key cut into
blocks, one task a pair of blocks. Classes joined by near signatures, directly or through others, form a cell. In a
cell, classes are dealt out by set size and a hash into blocks of bounded volume, and each task compares the whole
sets of a pair of blocks. A task returns a spanning forest of the links it found, which keeps every link's components
and is linear in the rows. Components are taken of links that were compared only, never of mere keys.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.llm.components import components
from strandway.llm.scratch import clear
from strandway.llm.words import Words, mix, plain, slices

POSITIONS, CHUNKS, ERRORS, BITS = 56, 14, 1, 16
FAR = 1e-7
#: Classes of a cell up to which it is one task, classes of a hot key's block, shingles of a cell's block (of 8 bytes
#: each, and about as much text), where a single longer document is a block of its own.
BLOCK, LARGEST, VOLUME = 256, 8192, 1 << 21
_MULTIPLY = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, POSITIONS + 1001, dtype=np.uint64))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-word shingles, lower-cased A-Z; of fewer words, the whole
    sequence as one; none without words."""
    for row, end in slices(texts):
        words = Words(texts, row, end, lower=True)
        grams = words.grams(n)
        for a, b in itertools.pairwise(words.first):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield mix(np.array([b - a], np.uint64) + mix(np.bitwise_xor.reduce(mix(words.hash[a:b] + np.arange(b - a, dtype=np.uint64)), keepdims=True)))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The lowest ``BITS`` bits of the mixed minimum under each of ``POSITIONS`` hash functions."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        for i in range(POSITIONS):
            h = part * _MULTIPLY[i] + _ADD[i]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            least[i] = min(least[i], h.min())
    return (least >> np.uint64(64 - BITS)).astype(np.uint16)


def _left_out() -> list[tuple[int, list[int]]]:
    size = POSITIONS // CHUNKS
    return [(c, [c * size + i for i in range(size) if i not in out]) for c in range(CHUNKS) for out in itertools.combinations(range(size), ERRORS)]


KEYS = _left_out()


def keys(signs: np.ndarray) -> np.ndarray:
    """For each signature (a row) one key for each chunk and each choice of positions left out of it."""
    own = signs.astype(np.uint64)
    out = np.empty((len(own), len(KEYS)), np.uint64)
    for k, (_, at) in enumerate(KEYS):
        value = np.full(len(own), k, np.uint64)
        for i in at:
            value = value << np.uint64(BITS) | own[:, i]
        out[:, k] = mix(value) + np.uint64(k)
    return mix(out).view(np.int64)


def _profiled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, signs = [], [], [], []
            for s in shingle_sets(plain(batch.column(1)), n):
                sizes.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                signs.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "sign"],
            )

    return run


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), POSITIONS)
        flat = keys(signs).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(ids, len(KEYS)))], ["key", "rep"])


def far(percent: int) -> int:
    """The signature-distance threshold: the least count of differing positions that a pair at a similarity of ``percent``
    is over with probability under FAR, or the most that the chunks guarantee; 25 at 85, 27 at 80."""
    p = 1 - percent / 100
    over = lambda d: sum(math.comb(POSITIONS, i) * p**i * (1 - p) ** (POSITIONS - i) for i in range(d + 1, POSITIONS + 1))
    return next(d for d in range(POSITIONS + 1) if over(d) < FAR or d == CHUNKS * (ERRORS + 1) - 1)


def _hamming(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _near(percent: int):
    """The pairs (rep, hub) with whether their signatures are near."""
    most = far(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.count_nonzero(_hamming(batch.column(2)) != _hamming(batch.column(3)), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart <= most)], ["rep", "hub", "near"])

    return run


def _signed(percent: int):
    """Near signatures of a key's classes, within one block, or between its two blocks and within the first where it
    is that block's turn."""
    most = far(percent)

    def link(table: pa.Table) -> pa.Table:
        ids, block, turn = (table.column(c).to_numpy() for c in ("rep", "block", "turn"))
        signs = _hamming(table.column("sign"))
        root, found = np.arange(len(ids)), []
        for a in range(len(ids) - 1):
            open_ = np.flatnonzero((root[a + 1 :] != root[a]) & ((block[a + 1 :] != block[a]) | turn[a])) + a + 1
            near = open_[np.count_nonzero(signs[open_] != signs[a], axis=1) <= most]
            roots, first = np.unique(root[near], return_index=True)
            if len(roots):
                found += [(ids[a], ids[b]) for b in near[first]]
                root[np.isin(root, roots)] = root[a]
        return _edges(found)

    return link


def _edges(found: list[tuple]) -> pa.Table:
    left, right = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _confirmed(percent: int, n: int):
    """Links by whole sets, of the same pairs of a cell."""

    def link(table: pa.Table) -> pa.Table:
        sets = list(shingle_sets(plain(table.column("payload")), n))
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[i] for i in order]
        ids, block, turn = (table.column(c).to_numpy()[order] for c in ("rep", "block", "turn"))
        sizes = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(values), np.int32)
        root, found = np.arange(len(ids)), []
        for a in range(len(ids) - 1):
            end = int(np.searchsorted(sizes, sizes[a] * 100 // percent, "right"))
            open_ = np.flatnonzero((root[a + 1 : end] != root[a]) & ((block[a + 1 : end] != block[a]) | turn[a])) + a + 1
            if not len(open_):
                continue
            mark[flat[at[a] : at[a + 1]]] = 1
            for some in np.array_split(open_, -(-len(open_) // 64)):  # a few sets' worth of work memory
                lengths = sizes[some]
                both = np.add.reduceat(mark[np.concatenate([flat[at[b] : at[b + 1]] for b in some])], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                for b in some[100 * both >= percent * (sizes[a] + lengths - both)]:
                    if root[b] != root[a]:
                        found.append((ids[a], ids[b]))
                        root[root == root[b]] = root[a]
            mark[flat[at[a] : at[a + 1]]] = 0
        return _edges(found)

    return link


def _meetings(block: Column, blocks: Column) -> Column:
    """(i, j, turn) of the pairs of blocks that a block takes part in; one of them looks within the block too."""
    pair = lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j"), (j == F.pmod(block + 1, blocks)).alias("turn"))
    return F.when(blocks > 1, F.transform(F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: j != block), pair)).otherwise(F.array(pair(block)))


def _keyed(index: DataFrame, first: DataFrame, percent: int, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs (a, b) of near signatures that connect all classes which near pairs of a common key connect."""
    hubs = index.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    shared = stage(index.join(hubs, "key").where("rep <> hub"), "shared")
    signs = first.select("rep", "sign")
    pairs = shared.select("rep", "hub").distinct().join(signs, "rep").join(signs.select(F.col("rep").alias("hub"), F.col("sign").alias("other")), "hub")
    tested = stage(pairs.select("rep", "hub", "sign", "other").mapInArrow(_near(percent), "rep long, hub long, near boolean"), "tested")
    near = tested.where("near").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    # a key of two classes is settled by their one pair
    apart = shared.where("m > 2").join(tested.where("NOT near").select("rep", "hub"), ["rep", "hub"])
    open_ = stage(apart.groupBy("key", "hub").agg(F.max("m").alias("m")), "open")
    members = index.join(open_.select("key", "m"), "key")
    blocks = F.ceil(F.col("m") / LARGEST).cast("int")
    placed = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep"), blocks).cast("int")})
    dealt = placed.select("key", "rep", "block", F.explode(_meetings(F.col("block"), F.col("blocks"))).alias("x")).join(signs, "rep")
    met = dealt.select("key", "rep", "block", "sign", "x.*").groupBy("key", "i", "j").applyInArrow(_signed(percent), "a long, b long")
    found = stage(near.unionByName(met).distinct(), "near")
    clear(shared, tested, open_)
    return found


def _compared(payload: DataFrame, cells: DataFrame, percent: int, link: Callable) -> DataFrame:
    """Links (a, b) within the cells, given rep and payload. A cell of over ``BLOCK`` classes is split by set size, in
    steps of the least ratio that linked sets can have, so that only equal and neighbouring sizes meet; sizes are split
    further by a hash into blocks of about VOLUME shingles. The join with the payload is a sort-merge join at every
    size."""
    of_size = W.partitionBy("cell").orderBy("size")
    step = math.log(100 / percent) * 1.000001
    totals = cells.groupBy("cell").agg(F.count("*").alias("m"))
    sized = cells.join(totals, "cell").withColumn("size", F.when(F.col("m") > BLOCK, F.floor(F.log("n_shingles") / step)).otherwise(0).cast("long"))
    units = sized.groupBy("cell", "size").agg(F.sum("n_shingles").alias("volume"), F.count("*").alias("k"))
    units = units.withColumn("blocks", F.least("k", F.ceil(F.greatest(F.col("volume") / VOLUME, F.col("k") / LARGEST))).cast("int"))
    next_to = lambda f, d: F.coalesce(F.when(f("size").over(of_size) == F.col("size") + d, f("blocks").over(of_size)), F.lit(0))
    units = units.withColumns({"up": next_to(F.lead, 1), "down": next_to(F.lag, -1)}).drop("volume", "k")
    placed = sized.drop("m").join(units, ["cell", "size"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    size, block, blocks, up, down = (F.col(c) for c in ("size", "block", "blocks", "up", "down"))
    unit = lambda s, b: s * (1 << 32) + b
    meeting = lambda s, j, turn: F.struct(unit(s, j).alias("other"), turn.alias("turn"))
    none = F.expr("CAST(array() AS array<struct<other:bigint,turn:boolean>>)")
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    same = F.when(blocks > 1, F.transform(F.filter(upto(blocks), lambda j: j != block), lambda j: meeting(size, j, j == F.pmod(block + 1, blocks)))).otherwise(none)
    above = F.when(up > 0, F.transform(upto(up), lambda j: meeting(size + 1, j, (blocks == 1) & (j == 0)))).otherwise(none)
    below = F.when(down > 0, F.transform(upto(down), lambda j: meeting(size - 1, j, (blocks == 1) & (up == 0) & (j == 0)))).otherwise(none)
    every = F.concat(same, above, below)
    every = F.when(F.size(every) > 0, every).otherwise(F.array(meeting(size, block, F.lit(True))))
    placed = placed.select("rep", "n_shingles", "cell", unit(size, block).alias("block"), every.alias("meets"))

    dealt = payload.join(placed.hint("merge"), "rep").select("rep", "n_shingles", "payload", "cell", "block", F.explode("meets").alias("x")).select("rep", "n_shingles", "payload", "cell", "block", "x.*")
    tasks = dealt.groupBy("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return tasks.applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, stage: Callable[[DataFrame, str], DataFrame], percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: documents are linked where 100 * intersection >=
    percent * union of their shingle sets, and component_id is the least id reachable.

    Null or wordless texts have no shingles and are linked with nothing. Rows that repeat an id are one document: what
    either is linked with, both are. A row with a null id gets a null component and is kept. Other columns of ``docs``
    don't matter. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = stage(rows.mapInArrow(_profiled(n), "doc_id long, n_shingles long, f1 long, f2 long, sign binary"), "profile")
    solid = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    prints = ["n_shingles", "f1", "f2"]
    classes = stage(solid.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "classes")
    members = stage(solid.select("doc_id", *prints).join(classes, prints).select("doc_id", "rep").distinct(), "members")

    first = solid.join(classes.select(F.col("rep").alias("doc_id"), *prints), ["doc_id", *prints], "left_semi").dropDuplicates(["doc_id", *prints])
    first = stage(first.select(F.col("doc_id").alias("rep"), "n_shingles", "sign"), "signatures")
    index = stage(first.select("rep", "sign").mapInArrow(_indexed, "key long, rep long"), "index")
    near = _keyed(index, first, percent, stage)
    clear(index)
    found = components(near, stage).select(F.col("node").alias("rep"), F.col("component").alias("cell"))
    cells = stage(found.join(first.select("rep", "n_shingles"), "rep"), "cells")
    texts = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), F.col("text").alias("payload"))
    links = _compared(texts, cells, percent, _confirmed(percent, n))
    several = members.groupBy("doc_id").count().where("count > 1")  # ids whose rows are in more than one class
    own = members.join(several, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stage(links.where("a <> b").unionByName(own), "links")
    labels = components(links, stage).select(F.col("node").alias("rep"), "component")
    named = members.join(labels, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = profile.select("doc_id", "n_shingles").join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
