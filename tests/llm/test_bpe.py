import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

FILE = P.path("byte_bpe_50k.tiktoken")


def codec():
    return bpe.Codec.load(FILE, P.PATTERN)


def test_whole_table_equals_the_library(spark, documents):
    got = {r["doc_id"]: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    for r in documents.collect():
        ids = codec().library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t\x1c\x85\xa0'séß東.,  "), max_size=60), st.integers(1, 9))
def test_cuts_are_safe(text, least):
    parts = list(bpe.pieces(text, least))
    assert "".join(parts) == text
    whole = codec().library.encode_ordinary(text)
    assert [i for p in parts for i in codec().library.encode_ordinary(p)] == whole


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1' \n\t\x1c\x85\xa0\u3000é東.,  \n "), max_size=60), st.integers(1, 9), st.integers(1, 5))
def test_runs_of_white_space_are_cut_as_the_pattern_does(text, least, run):
    parts = list(bpe.pieces(text, least, run))
    assert "".join(parts) == text
    whole = codec().library.encode_ordinary(text)
    assert [i for p in parts for i in (codec().library._encode_single_piece(p) if bpe._WHITE.fullmatch(p) else codec().library.encode_ordinary(p))] == whole


RUNS = (" ", "\n", "\t", "\u3000", " \n", "\r\n \t")


@pytest.mark.parametrize("run", RUNS)
@pytest.mark.parametrize("before,after", [("", ""), ("a", ""), ("", "x"), ("end.", "'s x"), ("1", "\x1c"), ("é ", " 東")])
def test_long_white_space_equals_the_library(run, before, after):
    for size in (4_095, 4_096, 4_097, 70_000):
        text = before + (run * size)[:size] + after
        assert codec().encode(text) == codec().library.encode_ordinary(text)


def test_very_long_white_space_takes_time_in_proportion():
    import time

    for run in RUNS:
        for after in ("", "x", " x" * 10):
            text = (run * 1_000_000)[:1_000_000] + after
            began = time.process_time()
            ids = codec().encode(text)
            assert time.process_time() - began < 5 and codec().decode(ids) == text.encode()
    began = time.process_time()
    for text in (" " * 10_000_000 + "x", "\n" * 10_000_000, "x" * 5_000_000, "a  b" * 1_000_000):
        assert codec().decode(codec().encode(text)) == text.encode()
    assert time.process_time() - began < 60


def test_other_patterns_are_refused():
    with pytest.raises(ValueError, match="boundaries"):
        bpe.Codec(FILE, r"\p{L}+|\s*[\r\n]+|\s+(?!\S)|\s+")


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    assert codec().decode(codec().encode(text)) == text.encode()


def test_long_texts_are_cut(monkeypatch):
    text = "word and more words\n" * 40_000 + "x" * 200_000
    assert len(list(bpe.pieces(text))) > 5
    assert codec().decode(codec().encode(text)) == text.encode()


def test_edges(spark, odd, empty):
    rows = bpe.round_trip(odd, FILE, P.PATTERN).collect()
    assert len(rows) == odd.count() and all(r["exact"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert bpe.round_trip(empty, FILE, P.PATTERN).count() == 0
    pair = bpe.decode(bpe.encode(odd, FILE, P.PATTERN), FILE, P.PATTERN)
    assert sorted(r["bytes"] for r in pair.collect()) == sorted((r["text"] or "").encode() for r in odd.collect())
