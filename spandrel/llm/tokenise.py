"""Byte-level BPE encoding of a corpus with a public vocabulary.

The merges of a piece run on a segment tree: its leaves are the byte positions, each holding the
rank of the pair that starts there (with the position, so the minimum at the root is the leftmost
pair of the lowest rank). A merge removes one position and updates its two live neighbours, each
in logarithmic time, so a piece of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spandrel.llm.arrow_rows import Bounded, small_batches

#: Where the public vocabularies lie unless the caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers split text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 62


def load_ranks(text: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i stops
    before = list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree = [_NEVER] * (2 * size)
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int) -> None:
        """New rank of the pair that starts at i, if there is one."""
        v, e = _NEVER, end[i]
        if e < n and (r := ranks.get(piece[i : end[e]])) is not None:
            v = r * n + i
        k = size + i
        tree[k] = v
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a < b else b
            if tree[k] == m:
                break
            tree[k] = m

    while (best := tree[1]) < _NEVER:
        i = best % n
        gone = end[i]
        end[i] = end[gone]
        if end[i] < n:
            before[end[i]] = i
        end[gone] = n  # a removed position starts no pair
        k = size + gone
        tree[k] = _NEVER
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a < b else b
            if tree[k] == m:
                break
            tree[k] = m
        put(i)
        if before[i] >= 0:
            put(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.split = regex.compile(pattern).findall
        self.memo = Bounded(lambda piece: merge_bytes(piece.encode("utf-8", "surrogatepass"), ranks))
        self.whole = lambda piece: merge_bytes(piece.encode("utf-8", "surrogatepass"), ranks)

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for piece in self.split(text):
            out += memo[piece] if len(piece) <= 64 else self.whole(piece)
        return out


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row; null and empty texts give an empty list. White space is
    text. No special tokens: their strings are ordinary text. Repeated rows are encoded each.
    The vocabulary (under 1 MB; its size is checked) goes to the executors once as a broadcast.
    """
    raw = Path(vocabulary).read_bytes()
    if len(raw) > 64 << 20:
        raise ValueError("vocabulary over 64 MB")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(load_ranks(shared.value))
        for b in small_batches(batches):
            ids = pa.array([encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
