"""Shared plumbing of operators that turn each row into many, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows handled between two yields; bounds the memory of a task whatever the texts' lengths.
ROWS = 256


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


class Bounded(dict):
    """A memo that starts afresh when full; it changes speed, never results."""

    def __init__(self, make: Callable, limit: int = 200_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = v = self.make(key)
        return v
