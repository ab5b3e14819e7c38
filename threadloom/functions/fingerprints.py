"""64-bit fingerprints of edited lines and hunks: FNV-1a with a splitmix finaliser, bit-exact, as Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

# FNV-1a basis and prime, finaliser multipliers, and the domain bytes of hunks and lines.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
HUNK, LINE = b"\x01", b"\x02"
MASK = (1 << 64) - 1


def fingerprint(data: bytes) -> int:
    """Signed 64-bit value, never 0."""
    h = BASIS
    for b in data:
        h = ((h ^ b) * PRIME) & MASK
    h = ((h ^ (h >> 30)) * MIX_1) & MASK
    h = ((h ^ (h >> 27)) * MIX_2) & MASK
    h = (h ^ (h >> 31)) or 1
    return h - (1 << 64) if h >> 63 else h


def line_print(line: str) -> int | None:
    """None for lines under three bytes or without a letter or digit."""
    line = line.strip()
    if len(line.encode()) < 3 or not any(c.isalnum() for c in line):
        return None
    return fingerprint(LINE + line.encode())


def hunk_print(text: str) -> int | None:
    """Print of the trimmed lines that aren't empty, so that indentation doesn't count."""
    kept = [line.strip() for line in text.split("\n") if line.strip()]
    return fingerprint(HUNK + "\n".join(kept).encode()) if kept else None


@pandas_udf(ArrayType(LongType()))
def edit_prints(texts: pd.Series) -> pd.Series:
    """The hunk's print, then its lines', each once, 64 at most."""

    def prints(text: str | None) -> list[int]:
        if not text:
            return []
        found = [hunk_print(text), *map(line_print, text.split("\n"))]
        return list(dict.fromkeys(p for p in found if p is not None))[:64]

    return texts.map(prints)
