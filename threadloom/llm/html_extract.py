"""Operator 10: main text of web pages by union-free wrappers of their hosts.

Each task aligns the pages of each host that it reads into one wrapper; wrappers of one
host are then merged in two steps, so that a hot host brings one row a task and not its
pages. Every page is then read again and matched with its host's wrapper: of the slots that
it has, those that hold the article are chosen for each layout, by whether they are fixed,
optional, repeated or template text in the expression, by text mass and link share, and
by element and class names as a hint.

Defined results: null html is empty and has an empty text; a page with a null or odd url
is a host of its own; unclosed and truncated markup reads as far as it goes; repeated rows
yield equal rows, and template text is told by different pages only; a page with nothing
but links yields an empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.html_pages import blocks
from threadloom.llm.wrappers import Slot, Wrapper, choose
from threadloom.session import written

#: hosts whose wrappers a task holds before it sends them on; layouts whose choice a task holds
HOSTS_IN_TASK = 2000
LAYOUTS_IN_TASK = 20_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))


def pack(wrapper: Wrapper) -> bytes:
    return zlib.compress(pickle.dumps(wrapper.__dict__), 1)


def unpack(data: bytes) -> Wrapper:
    out = Wrapper()
    out.__dict__.update(pickle.loads(zlib.decompress(data)))
    return out


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from ``pages`` (host, html)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, Wrapper] = {}

        def out() -> pa.RecordBatch:
            task = TaskContext.get().partitionId()
            return pa.record_batch({"host": pa.array(list(held), pa.string()), "task": pa.array([task] * len(held), pa.int32()), "wrapper": pa.array([pack(w) for w in held.values()], pa.binary())})

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                held.setdefault(host, Wrapper()).add(list(blocks(page.as_py() or "")))
            if len(held) >= HOSTS_IN_TASK:
                yield out()
                held = {}
        if held:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        total = Wrapper()
        for one in table.column("wrapper"):
            total.merge(unpack(one.as_py()))
        return table.slice(0, 1).select(["host", "task"]).append_column("wrapper", pa.array([pack(total)], pa.binary()))

    schema = "host string, task int, wrapper binary"
    parts = pages.select("host", "html").mapInArrow(align, schema)
    step = max(1, round(pages.rdd.getNumPartitions() ** 0.5))
    parts = parts.withColumn("task", F.pmod("task", F.lit(step))).groupBy("host", "task").applyInArrow(merge, schema)
    return parts.groupBy("host").applyInArrow(merge, schema).select("host", "wrapper")


def slots_of(found: DataFrame) -> DataFrame:
    """(host, slots): the status of each wrapper's slots, packed."""

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack_slots(unpack(w.as_py())) for w in batch.column("wrapper")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(packed, pa.binary())], names=["host", "slots"])

    return found.mapInArrow(state, "host string, slots binary")


def pack_slots(wrapper: Wrapper) -> bytes:
    return zlib.compress(pickle.dumps([(path, *slot) for path, slot in wrapper.status().items()]), 1)


def unpack_slots(data: bytes) -> dict[tuple, Slot]:
    return {path: Slot(*slot) for path, *slot in pickle.loads(zlib.decompress(data))}


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    named = with_host(pages.select("page_id", "url", "html"))
    slots = written(slots_of(wrappers(named.where("host <> ''"))), "slots").withColumnRenamed("host", "of")
    joined = named.join(slots, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "host", "slots")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[tuple, Slot]] = {}
        chosen: dict[tuple[str, frozenset], set] = {}
        for batch in batches:
            texts = []
            for host, page, packed in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("slots")):
                found = list(blocks(page.as_py() or ""))
                layout = frozenset(b.path for b in found)
                if not packed.is_valid:  # a page without a host
                    own = Wrapper()
                    own.add(found)
                    keep = own.content()
                elif (host, layout) in chosen:
                    keep = chosen[host, layout]
                else:
                    if len(held) >= HOSTS_IN_TASK or len(chosen) >= LAYOUTS_IN_TASK:
                        held.clear()
                        chosen.clear()
                    if host not in held:
                        held[host] = unpack_slots(packed.as_py())
                    keep = chosen[host, layout] = choose(held[host], layout)
                texts.append("\n".join(b.text for b in found if b.path in keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return joined.mapInArrow(read, schema)
