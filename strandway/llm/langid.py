"""Language identification by words first, then ever shorter character n-grams.

A word that the model knows counts with its log frequency in each language. A word it doesn't know is scored by its
character n-grams: at each place the longest known one counts, from the longest order down to single characters.

The model is fitted on a bounded sample: about ``SAMPLE`` labelled documents of each language, drawn by a hash of
their id; every value of lang is learned. It keeps the words, and for each order the n-grams, whose share of their
language is at least ``LEAST``. So a language has at most ``1 / LEAST`` words and as many n-grams of an order, whatever
the corpus, and a model of some dozens of languages can be broadcast. Nothing else depends on size: the option ``room``,
which is off, is for a model of very many languages that has to be smaller, at the price of its rare entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandway.llm.words import plain

SAMPLE, LEAST, ORDER = 3000, 4e-6, 4
#: Bytes of a model's entry besides its four bytes a language.
ENTRY = 150
#: Words outside the model whose scores a Python worker keeps.
MEMO = 200_000
WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> Counter:
    found = Counter(WORD.findall(text.lower()))
    if found and not any(x[0].isalpha() for x in found):
        found = Counter({x: n for x, n in found.items() if any(map(str.isalpha, x))})
    return found


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: Column | None = None, room: int | None = None) -> dict:
    """The model: languages in order, and the log share of each known word and n-gram in each language.

    Null texts and languages don't count, empty texts teach nothing, repeated rows count each time, other columns
    don't matter; no rows give an empty model. With ``room``, the least share is raised to the least power of two times ``LEAST``
    with which the model stays under so many bytes.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if keep is None else keep)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return {"langs": [], "at": {}, "logs": np.zeros((0, 0), np.float32)}
    share = F.create_map(*[F.lit(x) for s in sizes for x in (s["lang"], min(1.0, SAMPLE / s["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < share[F.col("lang")]).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(_words(text))
            flat = [(lang, word, n) for lang, c in found.items() for word, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], ["lang", "gram", "n"])

    words = drawn.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    framed = F.concat(F.lit("^"), F.col("gram"), F.lit("$"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.when(F.length(framed) >= k, F.transform(F.sequence(F.lit(1), F.length(framed) - k + 1), lambda i: F.struct(k.alias("k"), F.substring(framed, i, k).alias("g")))).otherwise(F.array().cast("array<struct<k:int,g:string>>"))))
    grams = words.select("lang", "n", F.explode(spans).alias("s")).groupBy("lang", F.col("s.k").alias("k"), F.col("s.g").alias("gram")).agg(F.sum("n").alias("n"))
    both = words.select("lang", F.lit(0).alias("k"), "gram", "n").unionByName(grams)
    totals = both.groupBy("lang", "k").agg(F.sum("n").alias("total"))
    shares = both.join(totals, ["lang", "k"]).select("lang", "k", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= LEAST).persist()
    least = 0
    if room is not None:
        level = F.floor(F.log2(F.max("share") / LEAST)).alias("level")  # at most 18 levels
        counts = {r["level"]: r["count"] for r in shares.groupBy("k", "gram").agg(level).groupBy("level").count().collect()}
        least = next(x for x in range(64) if sum(n for at, n in counts.items() if at >= x) * (4 * len(sizes) + ENTRY) <= room)
    table = shares.where(F.col("share") >= LEAST * 2.0**least).select("lang", "k", "gram", F.log("share").alias("log")).toPandas()
    shares.unpersist()
    langs = sorted(s["lang"] for s in sizes)
    names = [" " + g if k == 0 else g for k, g in zip(table.k, table.gram, strict=True)]  # no n-gram starts with a space
    at = {name: i for i, name in enumerate(dict.fromkeys(names))}
    logs = np.full((len(at), len(langs)), np.log(LEAST / 4), np.float32)
    place = {lang: i for i, lang in enumerate(langs)}
    if names:
        logs[[at[x] for x in names], [place[x] for x in table.lang]] = table.log.to_numpy()
    return {"langs": langs, "at": at, "logs": logs}


class Scorer:
    def __init__(self, model: dict) -> None:
        self.langs, self.at, self.logs = model["langs"], model["at"], model["logs"]
        self.memo: dict[str, np.ndarray] = {}
        self.floor = np.full(len(self.langs), np.log(LEAST / 4), np.float32)

    def unseen(self, word: str) -> np.ndarray:
        got = self.memo.get(word)
        if got is None:
            framed, rows = f"^{word}$", []
            for i in range(len(framed)):
                rows.append(next((r for k in range(ORDER, 0, -1) if (r := self.at.get(framed[i : i + k])) is not None), -1))
            hit = [r for r in rows if r >= 0]
            got = (self.logs[hit].sum(0) + (len(rows) - len(hit)) * self.floor) / len(rows)
            if len(self.memo) < MEMO:
                self.memo[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the belief in it); ('und', 0) without a letter or a model. Ties go to the first name."""
        found = _words(text) if text else None
        if not found or not self.langs:
            return "und", 0.0
        rows, counts, total = [], [], np.zeros(len(self.langs))
        for word, n in found.items():
            r = self.at.get(" " + word)
            if r is None:
                total += n * self.unseen(word)
            else:
                rows.append(r)
                counts.append(n)
        if rows:
            total += np.array(counts, np.float64) @ self.logs[rows]
        n = sum(found.values())
        belief = np.exp((total - total.max()) * min(1.0, 20 / n))
        best = int(np.argmax(total))
        return self.langs[best], float(belief[best] / belief.sum())


def predict(docs: DataFrame, model: dict, extra: list[Column] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``extra`` columns, lang_pred, score for every row, by a broadcast model of bounded size.

    A null text, or one without a letter, is ``und`` with score 0, as is every text under an empty model. Null ids and
    repeated rows give rows of their own; other columns don't matter; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), *extra, F.col(text_col).cast("string").alias("_text_"))
    names = given.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer.predict(x) for x in plain(batch.column(len(names))).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1]) + ", lang_pred string, score double"
    return given.mapInArrow(run, schema)
