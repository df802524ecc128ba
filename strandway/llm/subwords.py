"""A supervised text classifier of subword embeddings.

A word's features are the word itself and its character n-grams between ``^`` and ``$``, each hashed to one of
``BUCKETS`` learned vectors; a word that equals the one before it, or the one before that, has the feature of that
repeat besides. A document is the average of its words' features, whatever its length, and a softmax over
that gives the share of each class. Features are counted by Spark; numpy trains on them by stochastic gradient
descent with a falling rate, in one task, on at most ``SAMPLE`` labelled documents drawn by a hash of their id, which
is the documented bound: the training set is bounded, what is scored isn't.

As the output layer is linear, it is folded into the buckets once training is over: a model is ``BUCKETS`` rows of
class scores, a fixed megabyte or so, and a document's class scores are the average of its features' rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandway.llm.words import BYTE_BASE, WORD_BASE, Words, _powers, mix, plain, slices

#: Labelled documents to learn from at most; hashed vectors and their size; lengths of n-grams; passes; first rate.
SAMPLE, BUCKETS, DIMS, SHORTEST, LONGEST, PASSES, RATE = 4000, 1 << 17, 16, 2, 4, 6, 0.5
#: Distances at which a repeated word is noticed; their features come after the hashed ones.
REPEATS = (1, 2)
ROWS = BUCKETS + len(REPEATS)
#: Words whose scores a Python worker keeps; bytes of texts that are scored together.
MEMO, CHARS = 500_000, 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, which word) of all features of some words: each word's own, then its n-grams by length and place.

    A hash is a polynomial over code points modulo 2**64, with the length added, mixed; its highest bits are the bucket.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - starts[of]
    up = _powers(WORD_BASE, int(sizes.max()))[0]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    buckets, owners = [mix(np.add.reduceat(code * up[place], starts))], [np.arange(len(words))]
    gram = code
    for k in range(2, LONGEST + 1):
        gram = gram[:-1] * BYTE_BASE + code[k - 1 :]
        if k >= SHORTEST:
            whole = place[: len(gram)] + k <= sizes[of[: len(gram)]]
            buckets.append(mix(gram[whole] + np.uint64(k)))
            owners.append(of[: len(gram)][whole])
    return (np.concatenate(buckets) >> shift).astype(np.int64), np.concatenate(owners)


def bag(text: str) -> tuple[Counter, list[int]]:
    """The words of a text, counted, and how many of them repeat the one at each distance of ``REPEATS``."""
    words = WORD.findall(text)
    return Counter(words), [sum(map(str.__eq__, words, words[back:])) for back in REPEATS]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, shares = [], []
        for text in batch.text:
            words, repeats = bag(text)
            bucket, owner = hashed(list(words))
            total = np.bincount(bucket, np.fromiter(words.values(), np.float64, len(words))[owner], ROWS)
            total[BUCKETS:] = repeats
            ids.append(at := np.flatnonzero(total).astype(np.int32))
            shares.append((total[at] / max(total.sum(), 1)).astype(np.float32))
        yield pd.DataFrame({"draw": batch.draw, "label": batch.label, "ids": ids, "shares": shares})


def train(rows: pd.DataFrame, classes: int) -> np.ndarray:
    """A row of class scores for each feature and one of the classes' constants, learned from label, ids and shares of documents.

    Rows are taken in the given order, then in shuffled orders of a fixed seed, so the same rows give the same model.
    """
    rng = np.random.default_rng(1)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (ROWS, DIMS)).astype(np.float32)
    out, constant = np.zeros((classes, DIMS), np.float32), np.zeros(classes, np.float32)
    docs = [(int(y), np.asarray(i, np.int64), np.asarray(s, np.float32)) for y, i, s in zip(rows.label, rows.ids, rows.shares, strict=True)]
    steps = PASSES * max(1, len(docs))
    for turn in range(PASSES):
        for j, d in enumerate(rng.permutation(len(docs)) if turn else range(len(docs))):
            label, ids, shares = docs[d]
            rate = np.float32(RATE * (1 - (turn * len(docs) + j) / steps))
            hidden = shares @ vectors[ids]
            z = out @ hidden + constant
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            constant -= rate * np.float32(0.1) * p
            # a document's step is shared among its features; without that, one of a thousand features would not move
            vectors[ids] -= (rate / np.sqrt(shares @ shares)) * shares[:, None] * back if len(ids) else 0
    return np.concatenate([vectors @ out.T, constant[None, :]])


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str, stage: Callable[[DataFrame, str], DataFrame], classes: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> np.ndarray:
    """The model, learned from the texts of at most ``sample`` labelled documents, those of the smallest hash of id.

    Labels are whole numbers under ``classes``; null ids, null or other labels don't count, nor do null texts; a
    document with several labels or texts counts once, with the least of them. No rows give a model that knows nothing,
    in which each class has an even share. Other columns don't matter.
    """
    fine = labels.where(F.col(id_col).isNotNull() & F.col(label_col).between(0, classes - 1))
    each = fine.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    drawn = stage(each.withColumn("draw", F.xxhash64(F.lit("subwords"), "id")).orderBy("draw", "id").limit(sample), "drawn")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(drawn), "id").groupBy("id", "label", "draw").agg(F.min("text").alias("text"))  # at most ``sample`` rows
    counted = stage(texts.mapInPandas(_counted, "draw long, label int, ids array<int>, shares array<float>"), "counted")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model = train(rows.sort_values("draw", kind="stable").reset_index(drop=True), classes)
        return pd.DataFrame({"model": [model.astype("<f4").tobytes()]})

    made = stage(counted.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary"), "model").first()
    if made is None:
        return np.zeros((ROWS + 1, classes), np.float32)
    return np.frombuffer(made.model, "<f4").reshape(ROWS + 1, classes)


class Scorer:
    def __init__(self, model: np.ndarray) -> None:
        self.table, self.constant = model[:-1].astype(np.float64), model[-1].astype(np.float64)
        #: By hash of word, in order: the sums of its features' rows and their number.
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((0, len(self.constant) + 1))

    def _rows(self, words: list[str]) -> np.ndarray:
        bucket, owner = hashed(words)
        return np.stack([*(np.bincount(owner, column[bucket], len(words)) for column in self.table.T), np.bincount(owner, minlength=len(words))], 1).astype(np.float64)

    def _together(self, found: Words, docs: int) -> np.ndarray:
        """Class scores without the constants of the texts whose words are ``found``."""
        known, first, back = np.unique(found.hash, return_index=True, return_inverse=True)
        rows = np.zeros((len(known), len(self.constant) + 1))
        at = np.searchsorted(self.keys, known)
        hit = np.zeros(len(known), bool)
        hit[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == known[at < len(self.keys)]
        rows[hit] = self.sums[at[hit]]
        new = np.flatnonzero(~hit)
        rows[new] = self._rows([found.data[found.start[i] : found.stop[i]].tobytes().decode("utf-8", "replace") for i in first[new]])
        if room := max(0, MEMO - len(self.keys)):
            self.keys, self.sums = np.insert(self.keys, at[new[:room]], known[new[:room]]), np.insert(self.sums, at[new[:room]], rows[new[:room]], 0)
        of = np.repeat(np.arange(docs), np.diff(found.first))
        sums = np.stack([np.bincount(of, column[back], docs) for column in rows.T], 1).astype(np.float64)  # whole numbers, where there is no word
        for bucket, apart in enumerate(REPEATS, BUCKETS):
            same = of[apart:][(found.hash[apart:] == found.hash[:-apart]) & (of[apart:] == of[:-apart])]
            n = np.bincount(same, minlength=docs)
            sums += n[:, None] * np.append(self.table[bucket], 1)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The share of each class; that of a text without a word follows from the constants alone."""
        parts = [self._together(Words(texts, row, end), end - row) for row, end in slices(texts, CHARS)]
        z = np.concatenate([np.zeros((0, len(self.constant))), *parts]) + self.constant
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def score(docs: DataFrame, model: np.ndarray, extra: list[Column] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``extra`` columns, score (the share of each class, array<double>) for every row's whole text.

    Null and empty texts, and those of white space, have the score of no features. Null ids and repeated rows give rows
    of their own; other columns don't matter; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), *extra, F.col(text_col).cast("string").alias("_text_"))
    names = given.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = scorer.scores(plain(batch.column(len(names))))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32()), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cells], [*names, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1]) + ", score array<double>"
    return given.mapInArrow(run, schema)
