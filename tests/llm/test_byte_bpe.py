"""Byte-level BPE against the tiktoken library: random texts, and words of many thousand letters."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from rhetree.llm import byte_bpe


@pytest.fixture(scope="module")
def both():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.coder(byte_bpe.RANKS), plain


def same(both, texts):
    coder, plain = both
    ids, n = coder.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode_ordinary(text), text[:80]
    assert [b.decode() for b in coder.decode(ids, n)] == texts


def test_random_texts(both):
    rng = random.Random(4)
    letters = list(" \n\t\r aabbeétñ1290'.,;:sdΣß$♥🙂漢字仮名_-")
    same(both, ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)])


@pytest.mark.parametrize("letters", ["ab", "ACGT", "etaoinshrdlu", "aabcdefghijklmnopqrstuvwxyz", "漢字仮名交じり文的一是不了人我在有他这", "a"])
def test_long_words(both, letters):
    rng = random.Random(5)
    same(both, ["".join(rng.choice(letters) for _ in range(n)) for n in (255, 256, 257, 700, 5000)] + ["x" * 300 + "yz" * 400])


@pytest.mark.parametrize(("letters", "n"), [("ACGT", 100_000), ("ab", 50_000), ("aaab", 5000), ("ab=", 5000), ("etaon", 5000)])
def test_random_words_of_few_letters(both, letters, n):
    rng = random.Random(6)
    same(both, ["".join(rng.choice(letters) for _ in range(n))])


def test_places_that_no_token_crosses():
    inside = byte_bpe._inside([b"a", b"b", b"ab", b"abc", b"bcdef"])
    assert [int(x).to_bytes(4, "big") for x in inside[4]] == [b"bcde", b"cdef"]
    assert len(inside[2]) == len(inside[3]) == 1
