"""Cutting Arrow batches so that a task's arrays stay small."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

#: what a worker process keeps between tasks of one operator, by name
held: dict[str, object] = {}


def only(name: str) -> None:
    """Drops what the worker keeps for other operators; workers serve one after another."""
    others = [k for k in held if k != name]
    for k in others:
        del held[k]
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns freed memory of this worker to the system; workers stay, and so would what they once held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` of about ``limit`` text bytes; a longer single row is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) // limit).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()
