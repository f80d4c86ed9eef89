"""Evaluation texts leaking into training text, by winnowing.

A text is a sequence of words, compared without case, punctuation, markup, white space, line
prefixes, invisible characters and compatibility forms. Every k words are hashed, and of each
window of t - k + 1 such hashes the least is kept as a fingerprint. Two texts that share t words
in a row share a window, hence a fingerprint. Corpus and test fingerprints are joined on the hash
(the test side is broadcast if a count shows it small, else both are shuffled) and each hit is
extended to both sides to see whether t words in a row agree; the hashes of the words around a
fingerprint travel with it, so documents are read once and their texts never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import unicodedata
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.arrow_rows import Bounded, small_batches

SPAN = 13  # words in a row that make a leak
GRAM = 6  # words hashed together
BROADCAST_ROWS = 1_000_000  # test fingerprints (about 100 bytes each) that may be broadcast

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    if not text.isascii():
        t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", t))
    return _WORD.findall(text.lower() if text.isascii() else text)


def fingerprints(h: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of a sequence of word hashes. A sequence of fewer
    than ``span`` words has none: no leak fits into it."""
    n = len(h)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        g = g * _MIX + h[j : j + len(g)]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    win = np.lib.stride_tricks.sliding_window_view(g, span - gram + 1)
    at = np.unique(win.argmin(axis=1) + np.arange(len(win)))
    return at, g[at]


def _rows(batches: Iterator[pa.RecordBatch], gram: int, span: int) -> Iterator[pa.RecordBatch]:
    hashed = Bounded(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))
    side = span - gram  # words to either side that can matter
    width = gram + 2 * side
    for b in small_batches(batches):
        ids, hs, ctx = [], [], []
        for row, t in enumerate(b.column(1).to_pylist()):
            w = words(t) if t else ()
            if len(w) < span:
                continue
            h = np.fromiter((hashed[x] for x in w), np.uint64, len(w))
            at, f = fingerprints(h, gram, span)
            padded = np.zeros(len(h) + 2 * side, np.uint64)  # 0 stands for no word
            padded[side : side + len(h)] = h
            around = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
            ids.append(np.full(len(at), row))
            hs.append(f)
            ctx.append(around.astype("<u8").tobytes())
        if not ids:
            continue
        h = np.concatenate(hs).view(np.int64)
        data = pa.py_buffer(b"".join(ctx))
        offsets = pa.py_buffer(np.arange(0, (len(h) + 1) * width * 8, width * 8, dtype=np.int32))
        around = pa.Array.from_buffers(pa.binary(), len(h), [None, offsets, data])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(ids))), pa.array(h), around], ["id", "h", "ctx"])


def _fingerprint_rows(df: DataFrame, id_col: str, text_col: str, gram: int, span: int) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(df[id_col].alias("id"), df[text_col].alias("t")).where(F.col("t").isNotNull())
    return picked.mapInArrow(lambda it: _rows(it, gram, span), f"id {kind}, h bigint, ctx binary")


def longest_run(a: bytes, b: bytes, side: int) -> int:
    """Agreeing words in a row around the fingerprint; 0 if the fingerprint itself differs."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    same = (x == y) & (x != 0)
    if not same[side : len(same) - side].all():
        return 0
    left, right = same[:side][::-1], same[len(same) - side :]
    runs = [side if s.all() else int(s.argmin()) for s in (left, right)]
    return len(same) - 2 * side + sum(runs)


def leaked_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id",
                 item_text: str = "text", gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Distinct (doc, item) where the document holds ``span`` words of the item in a row.

    Null, empty and short texts on either side leak nothing; repeated rows count once.
    """
    if not 0 < gram <= span:
        raise ValueError("gram must be in 1..span")
    side = span - gram
    d = _fingerprint_rows(docs, doc_col, doc_text, gram, span)
    t = _fingerprint_rows(items, item_col, item_text, gram, span).select(F.col("id").alias("item"), "h", F.col("ctx").alias("item_ctx"))
    if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        t = F.broadcast(t)
    hits = d.join(t, "h").select("id", "item", "ctx", "item_ctx")

    def extend(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_run(x, y, side) for x, y in zip(a, b)], dtype="int64")

    runs = hits.withColumn("run", F.pandas_udf(extend, "bigint")("ctx", "item_ctx"))
    return runs.where(F.col("run") >= span).select(F.col("id").alias(doc_col), F.col("item").alias(item_col)).distinct()
