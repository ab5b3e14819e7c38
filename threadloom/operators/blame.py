"""Which commit a line of a file comes from, by carrying line ranges back through the hunks of a commits table.

A hunk of a diff without context says that ``old_lines`` lines at ``old_start`` became ``new_lines`` lines at
``new_start``. Asked ranges of the newest version go back commit by commit: what lies in a hunk's new lines
originates there, the rest moves by the sum of the hunks before it. The state of a file is its ranges still open,
which only shrink or split; commits stream by in order, and none is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.fingerprints import edit_prints
from threadloom.session import together

_OUT = pa.schema([("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("commit_id", pa.string()), ("origin", pa.int64())])
_HUNK = "struct<old_start: long, old_lines: long, new_start: long, new_lines: long>"
_SLICE = 512


def step_back(open_ranges: list[tuple[int, int, int]], hunks: list[dict]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Ranges (first, last, shift to the newest version) before a commit, and those (first, last, shift) that it wrote.

    A hunk of no new lines stands behind its line, so it is before the next one.
    """
    edges = sorted((h["new_start"] + (h["new_lines"] == 0), h["new_lines"], h["new_lines"] - h["old_lines"]) for h in hunks)
    left, wrote = [], []
    for first, last, shift in open_ranges:
        moved = 0
        for start, lines, grown in edges:
            if start > last:
                break
            if start + lines > first:
                if first < start:
                    left.append((first - moved, start - 1 - moved, shift + moved))
                inside = (max(first, start), min(last, start + lines - 1))
                if inside[0] <= inside[1]:
                    wrote.append((*inside, shift))
                first = max(first, start + lines)
            moved += grown
        if first <= last:
            left.append((first - moved, last - moved, shift + moved))
    return left, wrote


def _traced(rows: Iterator[dict]) -> Iterator[dict]:
    file, left = None, []

    def rest() -> Iterator[dict]:
        for first, last, shift in left:
            yield {"file": file, "first": first + shift, "last": last + shift, "commit_id": None, "origin": first}

    for row in rows:
        if row["file"] != file:
            yield from rest()
            file, left = row["file"], []
        if row["commit_id"] is None:
            left.append((row["first"], row["last"], 0))
        elif left:
            left, wrote = step_back(left, row["hunks"] or [])
            for first, last, shift in wrote:
                yield {"file": file, "first": first + shift, "last": last + shift, "commit_id": row["commit_id"], "origin": first}
    yield from rest()


def blame(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """(file, first, last, commit_id, origin): the origin of the ``asked`` lines (file, first, last) of each newest version.

    ``changes`` has a row for each commit that touches a file: file (a name that renames keep), seq, commit_id and hunks.
    ``origin`` is the first line's number in that commit's version; lines older than the table have a null commit.
    Overlapping ranges answer each for itself; null files and ranges that end before they begin are left out. Files without asked lines
    are not shuffled.
    """
    kind = f"array<{_HUNK}>"
    wanted = asked.where("file IS NOT NULL AND first <= last").select(
        "file", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("commit_id"), F.lit(None).cast(kind).alias("hunks"),
        F.col("first").cast("long"), F.col("last").cast("long"),
    )
    near = changes.where("commit_id IS NOT NULL").join(wanted.select("file").distinct(), "file", "left_semi").select(
        "file", F.col("seq").cast("long").alias("seq"), F.col("commit_id").cast("string").alias("commit_id"), F.col("hunks").cast(kind).alias("hunks"),
        F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"),
    )
    dealt = together(wanted.unionByName(near), "file").sortWithinPartitions("file", F.col("seq").desc_nulls_first(), "first", "last", "commit_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for at in range(0, batch.num_rows, _SLICE) for r in batch.slice(at, _SLICE).to_pylist())
        held: list[dict] = []
        for row in _traced(rows):
            held.append(row)
            if len(held) == _SLICE:
                yield pa.RecordBatch.from_pylist(held, _OUT)
                held = []
        yield pa.RecordBatch.from_pylist(held, _OUT)

    return dealt.mapInArrow(work, "file string, first long, last long, commit_id string, origin long")


def blamed_commits(blamed: DataFrame, texts: DataFrame) -> DataFrame:
    """(commit_id, commit_ts, file, prints) of the commits behind ``blamed`` lines: the targets that edits are matched with.

    ``texts`` (file, commit_id, commit_ts, line, text) holds the lines that commits wrote; each text's print and that of the joined run count.
    """
    lines = blamed.where("commit_id IS NOT NULL").select("file", "commit_id", F.col("origin").alias("run"), F.explode(F.sequence("origin", F.col("origin") + F.col("last") - F.col("first"))).alias("line"))
    said = lines.join(texts, ["file", "commit_id", "line"])
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    runs = said.groupBy("file", "commit_id", "commit_ts", "run").agg(run.alias("text"))
    return runs.select("file", "commit_id", "commit_ts", F.explode(edit_prints("text")).alias("print")).groupBy("file", "commit_id", "commit_ts").agg(F.collect_set("print").alias("prints"))
