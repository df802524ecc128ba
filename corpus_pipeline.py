"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of their input, whatever their names, with n_chars following the
text. Texts are worked on whole, however long. An empty table stays empty, and rows without an id are documents of their
own; what a stage does with null and empty texts and with repeated rows is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandway.llm import neardup, packing, quality, substrings, surrogates
from strandway.llm.scratch import clear, stage

KEY = "strandway"


NAMED = ("doc_id", "lang", "text")


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, and the other columns as one struct of plain names, which can't clash with what a stage adds."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in NAMED]
    return docs.select(*NAMED, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_rest"))


def _wide(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, with n_chars counted anew where there is one."""
    fresh = {"n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*[F.col(c) if c in NAMED else fresh.get(c, F.col(f"_rest.c{i}").alias(c)) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep. Null and empty texts have too few words and go;
    repeated rows are judged alike; documents without a language form a stratum of their own."""
    measured = stage(quality.measures(_narrow(docs)), "measured")
    chosen = stage(quality.cutoffs(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), stage=stage), "cutoffs")
    return _wide(quality.judge(measured, chosen).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id. Null and empty texts are like nothing and
    stay; rows that repeat an id are one document and stay or go together; of equal ties the least id stays."""
    found = stage(neardup.near_duplicates(docs, stage), "near")
    return docs.join(found.where("NOT kept").select("doc_id").hint("merge"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that start earlier in the corpus. Null texts have no words, and a
    document of which nothing is left stays, with an empty text; rows that repeat an id are one document."""
    return _wide(substrings.remove_repeats(_narrow(docs), stage, window=50), docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; equal data has equal surrogates in all of them. Null texts stay null."""
    return _wide(surrogates.replace(_narrow(docs), KEY), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens. A null or empty text is its end token alone; repeated
    rows are packed each."""
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)
    return packing.pack(pieces, 2048, stage)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("personal data", private_data),
    ("packing", pack_sequences),
]
#: Near-duplicate components, an FM-index and a tokenizer have no SQL form; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        after = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            clear(before)
        docs = before = after
    return docs
