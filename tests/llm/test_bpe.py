import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from docengine.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.parse_ranks(open(PATH, "rb").read())
OURS = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TABLE = bpe.token_table(RANKS)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab aab\n  é中'")), max_size=80))
def test_same_as_tiktoken_and_round_trip(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert bpe.decode_ids(ids, TABLE) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3001, " " * 4000, "\n\n x", "😀é" * 50, "z" * 50_000, "abcabcab" * 999, "<|endoftext|>", ""])
def test_long_and_odd_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12), min_size=1, max_size=20, unique=True))
def test_batch_equals_single(pieces):
    assert OURS.merge_many(pieces) == [np.array(OURS.merge(p), "<u4").tobytes() for p in pieces]


def test_unordered_table():
    """Ranks that no training gave: a merge makes a pair of lower rank."""
    ranks = {bytes([b]): 10 + b for b in range(256)} | {b"bc": 5, b"abc": 1, b"ab": 3, b"abcd": 0, b"cd": 4}
    e = bpe.Encoder(ranks, r"\S+|\s+")
    t = tiktoken.Encoding("o", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "aabcdcd", "bcdabcab", "abcabcd"):
        assert e.merge(text.encode()) == t.encode_ordinary(text)
        assert e.encode(text) == t.encode_ordinary(text)


def test_frames(spark):
    long = "wort" * 30_000
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "hello  world", "x", 5), (3, "hello  world", "x", 5), (None, "é", "x", 5), (4, long, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(found) == 6
    for r in found:
        texts = {1: b"", 2: b"", 3: b"hello  world", None: "é".encode(), 4: long.encode()}
        assert bytes(r["decoded"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) // 4
        assert hashlib.sha256(r["ids"]).digest() == hashlib.sha256(np.array(THEIRS.encode_ordinary(texts[r["doc_id"]].decode()), "<u4").tobytes()).digest()
    both = bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(both, key=str) == sorted(found, key=str)
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_vocabulary_without_a_byte():
    import pytest

    encoder = bpe.Encoder({b"a": 0, b"b": 1, b"ab": 2}, r"\w+")
    assert encoder.packed(["ab"]) == [b"\x02\0\0\0"]
    with pytest.raises(ValueError):
        encoder.packed(["abc"])
