"""Byte-level BPE through the public libraries, with a bounded memo of text chunks."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np

#: Bytes of chunks and their ids that a Python worker keeps; later ones are encoded each time they occur.
MEMO = 240 << 20
#: Of one entry, besides what its two strings hold.
ENTRY = 110
#: A lone space between two other characters: a match of the pattern starts there, whatever stands around it.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
SOLID = re.compile(r"\S+")
#: White space other than the blank, which with one next to it makes a run that must not be cut.
OTHER = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")


@functools.lru_cache(maxsize=4)
def bpe_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.lru_cache(maxsize=4)
def tiktoken_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=bpe_ranks(path), special_tokens={})


def safe_pieces(text: str, limit: int) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut before a lone space only, so that each piece can be
    encoded by itself. A stretch without such a place stays whole."""
    at = 0
    while len(text) - at > limit and (cut := BOUNDARY.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def lone_spaces(text: str) -> bool:
    """Whether every blank stands alone, so that a plain split finds the same places as ``BOUNDARY``."""
    return "  " not in text and not any(c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER)


class ChunkMemo:
    """Ids of a text by a ``tokenizers`` file of a byte-level BPE, as little-endian unsigned 32-bit integers.

    The text is cut before each blank that has no white space next to it, where the pre-tokenizer cuts too, so its ids
    are those of its chunks in a row. The first chunks a worker meets are kept with their ids, which covers the frequent ones; the others go
    through the library together for each text. A text with one of the file's added tokens goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.room = MEMO
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk with a space before it. Chunks without white space go through as one text, whose tokens
        that begin with a space tell where each one starts."""
        solid = [x for x in chunks if SOLID.fullmatch(x)]
        got: dict[str, bytes] = {}
        if solid:
            ids = np.array(self.library.encode_batch_fast([f" {' '.join(solid)}"], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(solid):
                data, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                got = {x: data[cuts[i] : cuts[i + 1]] for i, x in enumerate(solid)}
        if rest := [x for x in chunks if x not in got]:
            got.update(zip(rest, self._encode([f" {x}" for x in rest]), strict=True))
        return got

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):  # what the file lists as added tokens is found across blanks
            return self._encode([text])[0]
        head, *chunks = text.split(" ") if lone_spaces(text) else BOUNDARY.split(text)
        memo = self.memo
        if new := [x for x in chunks if x not in memo]:
            new = list(dict.fromkeys(new))
            got = self._words(new)
            size = sum(map(len, got.values())) + sum(map(len, got)) * (1 if text.isascii() else 4) + ENTRY * len(got)
            if size <= self.room:
                memo.update(got)
                self.room -= size
            else:
                return self._encode([head])[0] + b"".join([memo.get(x) or got[x] for x in chunks])
        return self._encode([head])[0] + b"".join(map(memo.__getitem__, chunks))


@functools.lru_cache(maxsize=2)
def chunk_memo(path: str) -> ChunkMemo:
    return ChunkMemo(path)
