"""Vectorised views of an Arrow text column: words, lines, hashes.

Tasks use these on one Arrow batch at a time; nothing here knows about Spark.
A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is
the same as the run of characters ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the rows' offsets in them (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Texts:
    """One batch of texts with lazily computed words and prefix hashes."""

    def __init__(self, column: pa.Array, lower_ascii: bool = False):
        self.raw, self.at = buffers(column)
        if lower_ascii:
            upper = (self.raw >= 65) & (self.raw <= 90)
            self.raw = self.raw + (upper * np.uint8(32)).astype(np.uint8)
        self.n = len(self.at) - 1
        self.inside = ~_SPACE[self.raw]
        before = np.zeros(len(self.raw), bool)
        before[1:] = self.inside[:-1]
        first = self.at[:-1][self.at[:-1] < len(self.raw)]
        before[first] = False
        after = np.zeros(len(self.raw), bool)
        after[:-1] = self.inside[1:]
        last = self.at[1:][self.at[1:] > 0] - 1
        after[last] = False
        self.starts = np.flatnonzero(self.inside & ~before)
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        #: words of row i are word_at[i]:word_at[i + 1]
        self.word_at = np.searchsorted(self.starts, self.at)
        self._prefix: tuple[np.ndarray, np.ndarray] | None = None

    def row_sums(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span; equal spans hash alike wherever they stand."""
        if self._prefix is None:
            n = len(self.raw) + 1
            power = np.full(n, MULTIPLIER, np.uint64)
            power[0] = 1
            np.cumprod(power, out=power)
            prefix = np.zeros(n, np.uint64)
            np.cumsum(_BYTE[self.raw] * power[:-1], out=prefix[1:])
            back = np.full(n, INVERSE, np.uint64)
            back[0] = 1
            np.cumprod(back, out=back)
            self._prefix = prefix, back
        prefix, back = self._prefix
        span = (prefix[ends] - prefix[starts]) * back[starts]
        return mix(span + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the \\n-split lines (an empty text is one empty line)."""
        breaks = np.flatnonzero(self.raw == 10)
        per_row = np.searchsorted(breaks, self.at)
        counts = np.diff(per_row) + 1
        rows = np.repeat(np.arange(self.n), counts)
        starts = np.empty(len(rows), np.int64)
        ends = np.empty(len(rows), np.int64)
        first = np.zeros(len(rows), bool)
        heads = np.cumsum(counts) - counts
        first[heads] = True
        starts[first] = self.at[:-1]
        starts[~first] = breaks + 1
        last = np.zeros(len(rows), bool)
        last[heads + counts - 1] = True
        ends[last] = self.at[1:]
        ends[~last] = breaks
        return starts, ends, rows


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within one row, and the index of its first word."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total = total * MULTIPLIER + hashes[k : len(hashes) - size + 1 + k]
    whole = np.flatnonzero(rows[: len(total)] == rows[size - 1 :])
    return mix(total[whole]), whole
