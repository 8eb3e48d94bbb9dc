import base64

import pytest

from stratalens.llm import tokens


@pytest.fixture(scope="module")
def ours():
    return tokens.Encoder()


def _reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "a", "Hello world, it's 12345.\n\n  x  ", "<|endoftext|>", "ตรวจสอบแคชก่อนเริ่มดัชนีทุกครั้ง" * 5,
    "索引词典占用88.94 GB，比管道大1029倍。" * 3, "a" * 5000, "ab" * 3001, "\u0000﻿\U0001f600 é é", "\r\n\t x　y",
    "def f(x):\n    return x ** 2  # ok\n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_the_public_library(ours, text):
    assert ours.encode(text) == _reference().encode_ordinary(text)


def test_rows(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x")], "doc_id long, text string, id string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode(d).collect())
    assert got[0][0] == 1 and got[1:] == [(2, []), (3, []), (3, [])]
    assert tokens.encode(d.limit(0)).count() == 0
    assert [r.n_tokens for r in tokens.token_counts(d, ["doc_id", "id"]).orderBy("doc_id").collect()] == [2, 0, 0, 0]
