import random

import numpy as np
import pytest
import tiktoken

from grapheion.llm import byte_bpe


@pytest.fixture(scope="module")
def pair():
    path, pattern = byte_bpe.default_vocabulary()
    c = byte_bpe.Codec(path, pattern)
    return c, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})


CASES = [
    "", " ", "  ", "\n", "a", "Hello world", "it's  we'll 'S don't", "x  \n\n  y\t\tz \n", "naïve éèê ß ü 漢字かな交じり文", "\x1c\x1d a\x1e\x1f b", "a\xa0b c　 d\x85e",
    "a\u1680b\u2003\u2009c\u2028d\u202fe\u205ff", "<|endoftext|> #$%&|<>", "1234567 12,34", "é ́x", "🙂🙃 family 👨‍👩‍👧", "aaaa" * 300, "ab" * 2000, "word " * 500 + "\n" * 300, "​﻿z\x00\x7f",
]


def test_equals_the_library(pair):
    c, ref = pair
    for text, ids in zip(CASES, c.encode(CASES), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text), repr(text)
        assert c.decode(ids) == text.encode()


def test_random_texts(pair):
    c, ref = pair
    rng = random.Random(5)
    alphabet = list("abcdeéßñ 'stm\n\t\r.,;:!?0123<>|#") + [" ", " ", "漢", "🙂", "\x1c", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    for text, ids in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text), repr(text)


def test_heap_and_matrix_agree(pair, monkeypatch):
    c, _ = pair
    rng = random.Random(6)
    words = [bytes(rng.choice(b"abcdefghijklmnopst ") for _ in range(rng.randrange(1, 120))) for _ in range(200)]
    by_matrix = c.encode_matches(words)
    monkeypatch.setattr(byte_bpe, "MATRIX_BYTES", 0)
    assert c.encode_matches(words) == by_matrix


def test_full_cache_changes_nothing(pair, monkeypatch):
    c, ref = pair
    monkeypatch.setattr(byte_bpe, "CACHE_SPANS", 0)
    fresh = byte_bpe.Codec(*byte_bpe.default_vocabulary())
    for text, ids in zip(CASES, fresh.encode(CASES), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text)


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "ab", None), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = byte_bpe.encode_digest(docs, *byte_bpe.default_vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 0), (1, 0), (3, 0)]
    assert byte_bpe.encode_digest(docs.limit(0), *byte_bpe.default_vocabulary()).count() == 0
