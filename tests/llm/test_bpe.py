import os

import pytest

from corvath.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no rank file here")


def test_matches_public_library_on_awkward_texts():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks)
    for text in ["", " ", "\n\n  x", "it's <|endoftext|> here", "ééé ÄÖ 漢字かな 🙂‍👩", "a" * 5000, "ab" * 3000 + "  \t end ", "x\r\ny", "½²³ 12345678901", "​­\x00"]:
        assert encoder.encode(text) == own.encode_ordinary(text)
        assert encoder.count(text) == len(own.encode_ordinary(text))


def test_null_empty_repeated_and_extra_columns(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "hello world", 7), (3, "hello world", 7), (None, "hello", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995]), (None, [31373])], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}[2] == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    encoder = bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    assert encoder.encode("one two three four five six one two") and len(encoder.words) <= 3
