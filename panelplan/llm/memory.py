"""Bounded memory in Python workers: slices by bytes, growing arrays, and giving freed memory back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 2048, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `rows` rows and `size` bytes in a text or binary column; a longer value is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Hand freed memory back to the machine: a worker stays alive and serves other stages next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that releases memory when its partition ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from over(batches)
        finally:
            release()

    return run


class Lists:
    """Lists of numbers laid end to end; room doubles, so that adding to them stays linear."""

    def __init__(self):
        self._flat, self._start, self._size = np.empty(1 << 10, np.int64), np.empty(1 << 8, np.int64), np.empty(1 << 8, np.int64)
        self.used = self.count = 0

    def __len__(self) -> int:
        return self.count

    @property
    def size(self) -> np.ndarray:
        """How many numbers each list has."""
        return self._size[: self.count]

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Add lists: their numbers in turn, and how many each has."""
        self._flat, self._start, self._size = _room(self._flat, self.used, len(flat)), _room(self._start, self.count, len(sizes)), _room(self._size, self.count, len(sizes))
        self._flat[self.used : self.used + len(flat)] = flat
        self._start[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self._size[self.count : self.count + len(sizes)] = sizes
        self.used += len(flat)
        self.count += len(sizes)

    def take(self, which: np.ndarray) -> np.ndarray:
        """The numbers of these lists in turn."""
        sizes = self._size[which]
        ends = np.cumsum(sizes)
        return self._flat[np.repeat(self._start[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    grown = np.empty(max(2 * len(array), used + more), array.dtype)
    grown[:used] = array[:used]
    return grown
