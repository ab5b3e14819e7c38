"""Passes over sorted rows that carry a small state from row to row instead of collecting groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

_ROWS = 512


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of ``batches``, few of them as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield from batch.slice(at, _ROWS).to_pylist()


def emit(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def carried(rows: DataFrame, key: str, order: list[Column | str], work: Callable[[Iterator[dict]], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """What ``work`` yields from the rows of each task, where the rows of a key come together and in ``order``.

    The rows of a key, null included, meet in one task and are sorted there by Spark, which spills;
    ``work`` sees them as one stream and holds no more than its own state.
    """
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(lambda batches: emit(work(rows_of(batches)), schema), ddl)
