"""Operator 3: token counts of sections by offset mapping.

Each whole text is encoded once. The tokens' byte lengths give their spans, and these are
joined to the text's sections as intervals: both lists are sorted, so a binary search finds
the first and the last section that a token touches. A token within one section counts
there. One that crosses a boundary goes by ``rule``: ``start`` to the section of its first
byte, ``majority`` to the section with most of its bytes (the earlier on a tie), ``split`` to
each in proportion to its bytes. A token, or part of one, outside all sections counts to
the section null.

Sections are an array of (name, start, end) in characters, end exclusive, in any order; where
two overlap the later start ends the earlier one; empty ones have no tokens; several of one
name add up. Defined results: a null text counts as empty; null sections or null bounds hold
nothing; a text gives one row for each of its section names, and a row for null if tokens are
left over; repeated rows count alike; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("start", "majority", "split")
_encoders: dict[tuple[str, str], tuple] = {}


def encoder(path: str, pattern: str):
    """The byte-pair encoding of a rank file and the byte length of each id; one for each worker."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[path, pattern]


def attribute(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each interval, the rest last. ``ends``: token ends (the first starts at 0); intervals sorted and disjoint."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    # edges of a partition of the line: gaps and intervals in turn
    edges = np.stack([starts, stops], axis=1).reshape(-1)
    first = np.searchsorted(edges, begins, "right")
    last = np.searchsorted(edges, np.maximum(ends - 1, begins), "right")
    out = np.zeros(len(starts) + 1)

    def slot(cell: np.ndarray) -> np.ndarray:
        return np.where(cell % 2 == 1, cell // 2, len(starts))

    whole = first == last
    np.add.at(out, slot(first[whole]), 1)
    crossing = np.flatnonzero(~whole)
    if rule == "start":
        np.add.at(out, slot(first[crossing]), 1)
        return out
    if not len(crossing):
        return out
    # one row for each crossing token and cell that it touches
    n = last[crossing] - first[crossing] + 1
    heads = np.cumsum(n) - n
    of = np.repeat(np.arange(len(crossing)), n)
    cells = first[crossing][of] + np.arange(len(of)) - heads[of]
    low = np.maximum(begins[crossing][of], np.concatenate([[0], edges])[cells])
    high = np.minimum(ends[crossing][of], np.concatenate([edges, ends[-1:]])[cells])
    share = np.maximum(high - low, 0)
    if rule == "majority":
        largest = np.flatnonzero(share == np.maximum.reduceat(share, heads)[of])
        _, earliest = np.unique(of[largest], return_index=True)
        np.add.at(out, slot(cells[largest[earliest]]), 1)
    else:
        np.add.at(out, slot(cells), share / np.add.reduceat(share, heads)[of])
    return out


def section_counts(text: str, sections: list, enc, sizes: np.ndarray, rule: str) -> dict:
    """name -> [characters, tokens]"""
    ids = np.asarray(enc.encode_to_numpy(text), np.int64) if text else np.zeros(0, np.int64)
    ends = np.cumsum(sizes[ids])
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    n = len(at) - 1
    spans = sorted((max(0, s["start"]), min(n, s["end"]), s["name"]) for s in sections if s and s["start"] is not None and s["end"] is not None)
    spans = [(a, min(b, spans[k + 1][0]) if k + 1 < len(spans) else b, name) for k, (a, b, name) in enumerate(spans)]
    out: dict = defaultdict(lambda: [0, 0.0])
    for s in sections:
        if s:
            out[s["name"]][0] += 0
    spans = [s for s in spans if s[1] > s[0]]
    starts, stops = (np.array([at[s[k]] for s in spans], np.int64) for k in (0, 1))
    got = attribute(ends, starts, stops, rule)
    for (a, b, name), tokens in zip(spans, got):
        out[name][0] += b - a
        out[name][1] += tokens
    if got[-1]:
        out[None][0] += n - sum(b - a for a, b, _ in spans)
        out[None][1] += got[-1]
    return out


def token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """(doc_id, section, n_chars, n_tokens) from ``docs`` (doc_id, text, sections)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoder(path, pattern)
        for batch in batches:
            which, rows = [], []
            for i, (text, sections) in enumerate(zip(batch.column("text"), batch.column("sections"))):
                for name, (chars, tokens) in section_counts(text.as_py() or "", sections.as_py() or [], enc, sizes, rule).items():
                    which.append(i)
                    rows.append((name, chars, tokens))
            names, chars, tokens = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(which, pa.int64())), "section": pa.array(names, pa.string()),
                "n_chars": pa.array(chars, pa.int64()), "n_tokens": pa.array(tokens, pa.float64()),
            })

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, section string, n_chars long, n_tokens double"
    return docs.select("doc_id", "text", "sections").mapInArrow(count, schema)


def head_body_tail(text: Column) -> Column:
    """Sections of a text: its first line, its last line if there is another, and what lies between."""
    size = F.length(text)
    first = F.when(F.instr(text, "\n") > 0, F.instr(text, "\n")).otherwise(size)
    last = F.greatest(first, size - F.when(F.instr(F.reverse(text), "\n") > 0, F.instr(F.reverse(text), "\n") - 1).otherwise(F.lit(0)))
    last = F.when(F.instr(text, "\n") > 0, last).otherwise(size)

    def part(name: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), a.cast("int").alias("start"), b.cast("int").alias("end"))

    return F.array(part("head", F.lit(0), first), part("body", first, last), part("tail", last, size))
