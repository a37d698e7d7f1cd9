"""Byte-level BPE encoding and decoding with a local rank file.

Encoding runs through the tiktoken library.  Long texts are first cut at safe boundaries: between a
character that isn't white space and white space that follows it.  Every alternative of the pre-splitting pattern takes one
blank at its start, or consists of white space alone and ends the pattern (TAIL), so no match crosses such a cut and none
changes on either side of it.  A pattern with other alternatives for white space is refused.

The library's matcher keeps a state for every character of a run of white space and breaks down on very long ones.  Such
runs are cut as TAIL cuts them: all of a run but its last character is one match (the whole run at the end of the text), and
the last character goes with what follows.  That match is encoded without the matcher.  Cuts are found in one forward pass,
so time is in proportion to the text, whatever it consists of; a run without white space stays whole.

Decoding concatenates the raw bytes of the ids; it needs no valid UTF-8.

Edge cases: a null text counts as empty (no ids, empty bytes); lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_columns

#: Characters of a piece of a long text, at least; the next safe cut ends it. Characters of a run of white space that is cut by hand.
PIECE, RUN = 65_536, 4_096
# The alternatives for white space that the cuts rest on, and what the library takes for white space.
TAIL = r"|\s+(?!\S)|\s+"
WHITE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_WHITE = re.compile(f"[{WHITE}]+")

_CACHE: dict[tuple[str, str], Codec] = {}


class Codec:
    """A vocabulary file in the text form ``base64 rank`` and the pattern that splits a text beforehand."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        if not pattern.endswith(TAIL) or r"\s" in pattern.removesuffix(TAIL).replace(r"[^\s", ""):
            raise ValueError("no safe boundaries are known for this pattern")
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (x.split() for x in lines if x.strip())}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]

    @classmethod
    def load(cls, rank_file: str, pattern: str) -> Codec:
        """One codec a process and file."""
        if (rank_file, pattern) not in _CACHE:
            _CACHE[rank_file, pattern] = cls(rank_file, pattern)
        return _CACHE[rank_file, pattern]

    def encode(self, text: str) -> list[int]:
        if len(text) <= RUN:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for piece in pieces(text):
            if len(piece) >= RUN - 1 and _WHITE.fullmatch(piece):
                ids += self.library._encode_single_piece(piece)
            else:
                ids += self.library.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def pieces(text: str, least: int = PIECE, run: int = RUN) -> Iterator[str]:
    """Cuts a text at safe boundaries; the pieces joined are the text.

    A run of run or more characters of white space (two at least) is a piece of its own, but for its last character where text follows.
    """
    long = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{max(2, run)},}}")
    start = 0
    for m in long.finditer(text):
        yield from _between(text, start, m.start(), least)
        start = m.end() - (m.end() < len(text))
        yield text[m.start() : start]
    yield from _between(text, start, len(text), least)


def _between(text: str, start: int, end: int, least: int) -> Iterator[str]:
    """The pieces of text[start:end], which holds no run to cut by hand."""
    while end - start > least and (cut := _CUT.search(text, start + least, end)):
        yield text[start : cut.start()]
        start = cut.start()
    if start < end:
        yield text[start:end]


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ids (the token ids), n_tokens, n_bytes."""

    def make():
        codec = Codec.load(rank_file, pattern)

        def work(keys, texts):
            ids = [codec.encode(t or "") for t in texts]
            return keys, ids, [len(x) for x in ids], [len((t or "").encode()) for t in texts]

        return work

    kind = dict(df.dtypes)[id_col]
    return map_columns(df, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>, n_tokens long, n_bytes long", make)


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a document: id, bytes (what the ids stand for; null ids count as none)."""

    def make():
        codec = Codec.load(rank_file, pattern)
        return lambda keys, ids: (keys, [codec.decode(x or []) for x in ids])

    kind = dict(df.dtypes)[id_col]
    return map_columns(df, [id_col, ids_col], f"`{id_col}` {kind}, bytes binary", make)


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256, exact.

    The ids themselves stay in the worker, so that only digests leave it.
    """

    def make():
        codec = Codec.load(rank_file, pattern)
        decimal, digest = codec.decimal, hashlib.sha256

        def work(keys, texts):
            counts, of_ids, of_bytes, exact = [], [], [], []
            for t in texts:
                ids = codec.encode(t or "")
                raw = codec.decode(ids)
                counts.append(len(ids))
                of_ids.append(digest(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(digest(raw).hexdigest())
                exact.append(raw == (t or "").encode())
            return keys, counts, of_ids, of_bytes, exact

        return work

    kind = dict(df.dtypes)[id_col]
    return map_columns(df, [id_col, text_col], f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean", make)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
