"""Corpus encoding with the rank file of a public byte-level BPE tokenizer.

A text is split by the tokenizer's pattern; every word that isn't itself an entry of the rank file is merged with a
segment tree over its byte positions, whose root is the leftmost pair of lowest rank. A merge changes at most three
leaves (the pair, its left neighbour, the byte that is gone), so a word of n bytes costs O(n log n), also where n is a
whole text without any white space.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("CORVATH_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of the rank files, as published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per Python worker; beyond this the memo starts anew (a matter of speed only, never of the result).
MEMO_WORDS = 150_000
MEMO_WORD_CHARS = 64
#: Texts are taken in slices of about this many characters, so that a batch of long texts doesn't fill a worker.
SLICE_CHARS = 2_000_000
_NONE = 1 << 62
_POSITION_BITS = 32


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return dict((base64.b64decode(word), int(rank)) for word, rank in map(bytes.split, f))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: repeatedly merges the leftmost adjacent pair of lowest rank."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    width = 1
    while width < n:
        width *= 2
    tree = [_NONE] * (2 * width)
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of = ranks.get
    for i in range(n - 1):
        if (r := rank_of(word[i : i + 2])) is not None:
            tree[width + i] = r << _POSITION_BITS | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        k //= 2
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k //= 2

    def pair(i: int) -> int:
        j = following[i]
        if j >= n:
            return _NONE
        r = rank_of(word[i : following[j]])
        return _NONE if r is None else r << _POSITION_BITS | i

    while (least := tree[1]) != _NONE:
        i = least & ((1 << _POSITION_BITS) - 1)
        gone = following[i]
        following[i] = following[gone]
        if following[i] < n:
            previous[following[i]] = i
        put(gone, _NONE)
        put(i, pair(i))
        if previous[i] >= 0:
            put(previous[i], pair(previous[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : following[i]]])
        i = following[i]
    return ids


class _Words(dict):
    """Word to ids, filled as words are met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else merge_word(data, self.ranks)
        if len(word) <= MEMO_WORD_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts; text that looks like a special token is plain text."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.split = regex.compile(PATTERN).findall
        self.words = _Words(ranks)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.split(text)))) if text else 0


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(key: str, ranks: dict[bytes, int]) -> Encoder:
    """One encoder per Python worker and vocabulary; workers are reused by later tasks."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _run(documents: DataFrame, id_col: str, text_col: str, vocabulary: str, out: str, kind: pa.DataType, ddl: str, make) -> DataFrame:
    # The rank file is read on the driver (about 50,000 entries, 1 MB) and broadcast: executors need no copy of it.
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or encoder_of(vocabulary, ranks.value)
            at = 0
            for part in _slices(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), make(encoder, part, kind)], names=[id_col, out])
                at += len(part)

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"`{id_col}` {id_type}, `{out}` {ddl}")


def _ids(encoder: Encoder, texts: list[str | None], kind: pa.DataType) -> pa.Array:
    flat: list[int] = []
    ends = np.zeros(len(texts) + 1, dtype=np.int32)
    get, split = encoder.words.__getitem__, encoder.split
    for i, text in enumerate(texts, 1):
        if text:
            flat.extend(chain.from_iterable(map(get, split(text))))
        ends[i] = len(flat)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _counts(encoder: Encoder, texts: list[str | None], kind: pa.DataType) -> pa.Array:
    return pa.array([encoder.count(t) for t in texts], kind)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id_col and `ids` (array<int>), one row per input row, without special tokens.

    A null and an empty text both give an empty array; repeated rows are encoded as often as they come; a null id stays
    null; columns other than the two named are not read, so their names can't clash. The work is one narrow stage: no
    shuffle, and a worker holds one slice of texts at a time.
    """
    return _run(documents, id_col, text_col, vocabulary, "ids", pa.list_(pa.int32()), "array<int>", _ids)


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id_col and `n_tokens` (bigint), the number of ids that encode_corpus gives; 0 for null and empty texts."""
    return _run(documents, id_col, text_col, vocabulary, "n_tokens", pa.int64(), "bigint", _counts)
