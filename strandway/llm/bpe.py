"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandway.llm.tokens import safe_pieces, tiktoken_encoding
from strandway.llm.words import plain

#: Characters of a text that go through the library at once.
PIECE = 1 << 16


def _encoded(path: str, pattern: str, rows: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tiktoken_encoding(path, pattern)
        for batch in batches:
            ids = [[i for piece in safe_pieces(text, PIECE) for i in library.encode_ordinary(piece)] for text in plain(batch.column(1)).to_pylist()]
            yield rows(batch.column(0), ids, library)

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of each text. A null text is empty; special tokens are ordinary text."""

    def rows(keys, ids, _):
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encoded(ranks, pattern, rows), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, data: the raw bytes of ids; a sequence that was cut inside a character gives the bytes it has. A null
    list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tiktoken_encoding(ranks, pattern)
        for batch in batches:
            data = [None if ids is None else library.decode_bytes(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass: encode, digest the ids, decode, digest the bytes.

    A null text is an empty one; null ids and repeated rows give rows of their own; very long texts are cut at safe
    places only; other columns, whatever their names, don't matter; an empty table gives no rows.
    """

    def rows(keys, ids, library):
        arrays = [np.array(x, "<u4") for x in ids]
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in arrays]),
                pa.array([hashlib.sha256(library.decode_bytes(x)).hexdigest() for x in ids]),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(text_col))
    return kept.mapInArrow(_encoded(ranks, pattern, rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias("text")
