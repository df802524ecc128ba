"""Removal of word sequences that occur earlier in the corpus, by an FM-index per shard.

Each window of ``WINDOW`` words has a minimizer, the least hash of its 5-grams, so equal windows have equal ones. A
run of windows with one minimizer is a segment; about every ninth word opens one. Segments whose minimizer occurs
once go no further. Of segments with the same words all but the earliest repeat as a whole, which a partial aggregate
finds. The distinct ones that share a minimizer go to shards by it; a shard builds an FM-index and streams its
segments through backward search, which gives the windows that also start earlier; runs of them are the intervals
reported. A minimizer that leads more text than a shard may hold is split: its windows are dealt out one by one, where
again an aggregate finds the earliest. That changes where windows are compared, not what is found.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandway.llm.fmindex import FMIndex
from strandway.llm.words import Words, plain, slices, span_hash

GRAM = 5
#: Words of one index, and of one minimizer's segments, at most (a segment of one document may be longer).
SHARD, HOT = 1 << 20, 1 << 18
WORD = re.compile(rb"([^\x20\x09-\x0D]+)")
SEGMENT = "doc_id long, start int, n int, m long, h long, again boolean"


def segments(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, minimizer, hash, whether the minimizer occurs twice in it) of the segments of all rows."""
    total, reach = len(words.hash), window - GRAM + 1
    if total < window:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    grams = words.grams(GRAM)
    least, width = grams, 1
    while width * 2 <= reach:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    counts = np.diff(words.first)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(total) - words.first[:-1][row]
    valid = (place + window <= counts[row])[: len(least)]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(opens)
    number = np.cumsum(opens)[valid] - 1
    n = np.bincount(number, minlength=len(start))
    spread = np.cumsum(n + reach - 1)
    at = np.arange(spread[-1] if len(n) else 0) - np.repeat(spread - (n + reach - 1) - start, n + reach - 1)
    times = np.add.reduceat(grams[at] == np.repeat(least[start], n + reach - 1), spread - (n + reach - 1), dtype=np.int64) if len(n) else n
    return row[start], place[start], n, least[start].view(np.int64), span_hash(words.hash, start, start + n + window - 1).view(np.int64), times > 1


def _segmented(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), plain(batch.column(1))
            for at, end in slices(texts):
                row, start, n, m, h, again = segments(Words(texts, at, end), window)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + row], pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(m), pa.array(h), pa.array(again, pa.bool_())], ["doc_id", "start", "n", "m", "h", "again"])

    return run


def _contents(window: int, single: bool):
    """The words of the wanted segments of each text; with ``single``, the hash of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = plain(batch.column(1)), batch.column(2).to_pylist()
            for at, end in slices(texts):
                words = Words(texts, at, end)
                grams = words.grams(window) if single else None
                rows = []
                for i, first in enumerate(words.first[:-1]):
                    key = batch.column(0)[at + i].as_py()
                    for want in wanted[at + i]:
                        a = first + want["start"]
                        if single:
                            rows += [(h, key, want["start"] + k) for k, h in enumerate(grams[a : a + want["n"]].view(np.int64).tolist())]
                        else:
                            rows.append((want["m"], key, want["start"], words.hash[a : a + want["n"] + window - 1].tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()][: 3 if single else 4]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["m", "doc_id", "start", "words"][: len(kinds)])

    return run


def _searched(window: int):
    """Spans of repeated windows. Rows come sorted by (m, doc_id, start); an index is cut where m changes."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1:3])
        parts = [np.frombuffer(r[3], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in parts])
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        values, flat = np.unique(np.concatenate(parts), return_inverse=True)
        text = np.zeros(at[-1], np.int64)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        text[inside] = flat + 1
        base = at[:-1].copy()  # rows of the same document and place are the same occurrence
        for i in range(1, len(rows)):
            if rows[i][1:3] == rows[i - 1][1:3]:
                base[i] = base[i - 1]
        own = np.repeat(np.arange(len(rows)), sizes + 1)
        place = np.arange(at[-1]) - at[own]
        key = base[own] + place
        starts = np.flatnonzero(place + window <= sizes[own])
        index = FMIndex(text, len(values) + 1, window)
        start, lo, hi = index.repeated(text, starts, window)
        if len(start):
            order = np.argsort(lo, kind="stable")
            start, lo, hi = start[order], lo[order], hi[order]
            first = np.concatenate([[True], lo[1:] != lo[:-1]])
            keys = np.append(key[index.suffixes], 0)
            edges = np.stack([lo[first], hi[first]], 1).ravel()
            earliest = np.minimum.reduceat(keys, edges)[::2][np.cumsum(first) - 1]
            start = np.sort(start[key[start] > earliest])
        new = np.concatenate([[True], (np.diff(start) != 1) | (own[start[1:]] != own[start[:-1]])]) if len(start) else np.zeros(0, bool)
        a = start[new]
        b = start[np.concatenate([new[1:], [True]])] + window if len(start) else a
        ids, begun = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[own[a]], pa.int64()), pa.array(begun[own[a]] + place[a], pa.int32()), pa.array(begun[own[a]] + b - at[own[a]], pa.int32())], ["doc_id", "start", "stop"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD and row[0] != rows[-1][0]:
                    yield search(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3]) // 8
        if rows:
            yield search(rows)

    return run


def _cleaned(names: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            raw = batch.column(text_at)
            texts, n_words, n_removed, digests = [], [], [], []
            for text, own in zip(raw.to_pylist(), spans, strict=True):
                parts = WORD.split((text or "").encode())  # gap, word, gap, word, ..., gap
                words = parts[1::2]
                gone = 0
                if own:
                    keep = np.ones(len(words), bool)
                    for s in own:
                        keep[s["start"] : s["stop"]] = False
                    gone = int(len(words) - np.count_nonzero(keep))
                    left = np.flatnonzero(keep).tolist()
                    text = b"".join(itertools.chain.from_iterable((parts[2 * i], parts[2 * i + 1]) for i in left)).strip(b" \t\n\x0b\f\r").decode()
                    words = [words[i] for i in left]
                texts.append(text)
                n_words.append(len(parts) // 2)
                n_removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns[: len(names)])]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_n_words", "_n_removed", "_kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, stage: Callable[[DataFrame, str], DataFrame], window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop: word ranges covered by windows that also start earlier, that is in a document of smaller
    id, or earlier in the same one. Ranges may overlap. Rows that repeat an id are the same document: the same
    place in both is one occurrence. Null ids and null or shorter texts give none."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.select("doc_id", "text").mapInArrow(_segmented(window), SEGMENT)
    shared = stage(found.groupBy("m").agg(F.count("*").alias("c"), F.max("again").alias("again")).where("c > 1 OR again").select("m"), "shared")
    some = stage(found.join(shared, "m"), "segments")
    place = F.struct("doc_id", "start")
    firsts = stage(some.groupBy("m", "h").agg(F.min(place).alias("f"), F.max("n").alias("n"), F.max("again").alias("again")), "firsts")
    stop = (F.col("start") + F.col("n") + window - 1).cast("int")
    spans = some.join(firsts.select("m", "h", "f"), ["m", "h"]).where(place != F.col("f")).select("doc_id", "start", stop.alias("stop"))

    mass = firsts.groupBy("m").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + window - 1).alias("mass"))
    open_ = firsts.join(mass, "m").where((F.col("kinds") > 1) | F.col("again")).select("f.doc_id", "f.start", "n", "m", ((F.col("mass") > HOT) & (F.col("kinds") > 1)).alias("hot"))
    wanted = stage(open_, "wanted")

    def texts(hot: bool) -> DataFrame:
        lists = wanted.where(F.col("hot") == hot).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "m")).alias("want"))
        return rows.join(lists.hint("merge"), "doc_id").select("doc_id", "text", "want")

    contents = texts(False).mapInArrow(_contents(window, single=False), "m long, doc_id long, start int, words binary")
    size = wanted.where("NOT hot").agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD + 1)
    searched = contents.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(_searched(window), "doc_id long, start int, stop int")
    spans = spans.unionByName(searched)
    if not wanted.where("hot").isEmpty():
        single = stage(texts(True).mapInArrow(_contents(window, single=True), "m long, doc_id long, start int"), "single")
        first = single.groupBy("m").agg(F.min(place).alias("f"))
        later = single.join(first, "m").where(place != F.col("f"))
        spans = spans.unionByName(later.select("doc_id", "start", (F.col("start") + window).cast("int").alias("stop")))
    return spans


def remove_repeats(docs: DataFrame, stage: Callable[[DataFrame, str], DataFrame], window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the words that ``repeated_spans`` covers, and n_words, n_removed, kept_sha256.

    The white space before a removed word goes with it; a text that loses nothing is unchanged, a null text stays null
    with no words. Columns of ``docs`` that have the names of the three new ones are replaced. An empty table gives no
    rows.
    """
    spans = stage(repeated_spans(docs, stage, window, id_col, text_col), "spans")
    own = spans.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    new = ["n_words", "n_removed", "kept_sha256"]
    names = [c for c in docs.columns if c not in new]
    coded = [f"c{i}" for i in range(len(names))]
    given = docs.select(*[(F.col(f"`{c}`").cast("string") if c == text_col else F.col(f"`{c}`")).alias(k) for c, k in zip(names, coded, strict=True)])
    joined = given.join(own.hint("merge"), F.col(coded[names.index(id_col)]).cast("long") == F.col("key"), "left").select(*coded, "spans")
    schema = ", ".join(f"{k} {t}" for k, t in given.dtypes) + ", _n_words long, _n_removed long, _kept_sha256 string"
    out = joined.mapInArrow(_cleaned(coded, names.index(text_col)), schema)
    return out.toDF(*names, *new)
