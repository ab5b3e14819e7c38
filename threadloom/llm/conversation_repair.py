"""Operator 12: conversation structure repair by A* on the edit lattice.

A conversation is right if the initials of its roles match ``(s?(ua)+)?``. A node of the
lattice is a row yet to be handled and a state of that expression; from it lead the edits
Keep (0), Rerole to user or assistant (3), Delete (4, the only one for blank and repeated rows)
and Insert of an empty user or assistant turn before the row (3); rows that end without
a full stop cost 3 more unless deleted. A* takes nodes by (cost plus heuristic, audit), the audit being
the edits' initials so far. The heuristic is the suffix sum of mandatory deletions and of the 3 that a
truncated row costs at least; it is consistent, and from a state each letter leads to one node, so the first
goal taken is the cheapest with the least audit.

Rows are range-sorted once and written with their place in the global order. The 2**BLOCK_BITS
rows of a block are compact codes of one letter, and a conversation's run in a block is a segment:
ordinary conversations are one segment, a hot one is many, searched in parallel. For that each
segment's cheapest costs between all states are computed first (a min-plus product), a pass backward over
segments gives what follows a segment costs from each state, A* runs in every segment from each state it can
be entered in with those costs at its end, and a pass forward picks the state that the segment before ends in.
Segment audits are prefix-free, so the least audits of segments make the least audit of the whole.

Defined results: null role and text are one space; rows go by turn, nulls first, then role,
then text; equal rows are interchangeable; a null conv_id is a conversation of its own; a role counts by its first
character; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.streams import carried, emit, rows_of
from threadloom.session import written

BLOCK_BITS = 10
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40

#: where a kept turn of an initial leads from each state
KEEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: the turn that may be inserted or made of another one in each state
WANTED = ["u", "u", "a", "u"]
#: inserts that make each state a right end
ENDS = [0, 2 * INSERT, INSERT, 0]
#: row codes: D must go; the initial, x for any other; in capitals if truncated
CODES = "DuasxUASX"


def row_edits(state: int, code: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that take a row of ``code``."""
    yield "D", DELETE, state
    if code != "D":
        charge, initial = TRUNCATED * code.isupper(), code.lower()
        if initial in KEEP[state]:
            yield "K", charge, KEEP[state][initial]
        if initial != WANTED[state]:  # else Keep leads to the same node for less
            yield "R", REROLE + charge, KEEP[state][WANTED[state]]


def step_costs(code: str) -> np.ndarray:
    """Cheapest costs between all states of taking one row, with inserts before it."""
    out = np.full((4, 4), FAR, np.int64)
    for entry in range(4):
        state, paid = entry, 0
        for _ in range(4):
            for _, cost, to in row_edits(state, code):
                out[entry, to] = min(out[entry, to], paid + cost)
            state, paid = KEEP[state][WANTED[state]], paid + INSERT
    return out


def crossing_costs(codes: list[str]) -> np.ndarray:
    """Cheapest costs between all states of each segment, all segments at once."""
    steps = np.stack([*map(step_costs, CODES), np.where(np.eye(4, dtype=bool), 0, FAR)])
    size = max(map(len, codes), default=0)
    place = np.full((len(codes), size), len(CODES))
    for i, c in enumerate(codes):
        place[i, : len(c)] = [CODES.index(x) for x in c]
    costs = np.broadcast_to(steps[-1], (len(codes), 4, 4))
    for j in range(size):
        costs = np.minimum((costs[:, :, :, None] + steps[place[:, j]][:, None]).min(axis=2), FAR)
    return costs


def cheapest(codes: str, entry: int, exits: list[int] | None) -> tuple[int, str, int]:
    """(cost, audit, end state) of a segment's best edits from ``entry``; ``exits`` is what follows costs from each state, None at the end."""
    n = len(codes)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if codes[i] == "D" else TRUNCATED * codes[i].isupper())
    least = min(exits) if exits else 0
    heap, done = [(rest[0] + least, "", 0, entry, False)], set()
    while True:
        total, audit, i, state, goal = heapq.heappop(heap)
        if goal:
            return total - (exits[state] if exits else 0), audit, state
        if (i, state) in done:
            continue
        done.add((i, state))
        paid = total - rest[i] - least
        if i < n:
            for letter, cost, to in row_edits(state, codes[i]):
                if (i + 1, to) not in done:
                    heapq.heappush(heap, (paid + cost + rest[i + 1] + least, audit + letter, i + 1, to, False))
        elif exits:
            heapq.heappush(heap, (paid + exits[state], audit, i, state, True))
            continue
        elif not ENDS[state]:
            heapq.heappush(heap, (paid, audit, i, state, True))
        to = KEEP[state][WANTED[state]]
        if (i, to) not in done:
            heapq.heappush(heap, (paid + INSERT + rest[i] + least, audit + "I", i, to, False))


def row_marks(codes: str, audit: str, state: int) -> list[str]:
    """The audit dealt to rows: u and a for turns inserted before (or after the last) row, then K, D, U or A for the row itself."""
    marks, i, ahead = [], 0, ""
    for letter in audit:
        wanted = WANTED[state]
        if letter == "I":
            ahead, state = ahead + wanted, KEEP[state][wanted]
            continue
        marks.append(ahead + (wanted.upper() if letter == "R" else letter))
        state = next(to for x, _, to in row_edits(state, codes[i]) if x == letter)
        i, ahead = i + 1, ""
    if ahead:
        marks[-1] += ahead
    return marks


class Repair(NamedTuple):
    """``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns``: conv_id, at, place, role, text, edit, in order of (at, place)."""

    report: DataFrame
    turns: DataFrame


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, ascending in the order of conversations, turns, roles and texts, and consecutive in each block."""
    plain = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    by = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    # equal rows, however many, are dealt to several ranges by where they were read
    by = [*by, F.col("_read")]
    dealt = plain.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    return written(dealt.drop("_read").withColumn("at", F.monotonically_increasing_id()), "turns")


def _block(at: Column) -> Column:
    return F.shiftright(at, BLOCK_BITS)


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, block, start, codes, initials, blank, duplicate, truncated, first, last): the runs of conversations in blocks of ``ordered`` rows."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    seen = F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"))
    codes = rows.select(
        "conv_id", "at", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.when(first.isin("u", "a", "s"), first).otherwise("x").alias("initial"), seen.alias("seen"),
    )
    # the earliest of equal rows is known by its place, so that no group of equal rows is joined
    once = codes.where("NOT blank").groupBy("conv_id", "seen").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open"), "truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault").isNull(), F.col("initial")).otherwise(F.upper("initial"))
    marked = codes.drop("seen").join(once, "at", "left").withColumn("fault", fault).withColumn("code", code)
    line = F.array_sort(F.collect_list(F.struct("at", "code", "initial")))  # at most 2**BLOCK_BITS
    found = marked.groupBy("conv_id", _block(F.col("at")).alias("block")).agg(
        line.alias("line"), *(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated"))
    )
    own = Window.partitionBy("conv_id")
    return found.select(
        "conv_id", "block", F.col("line")[0]["at"].alias("start"), F.array_join("line.code", "").alias("codes"), F.array_join("line.initial", "").alias("initials"),
        "blank", "duplicate", "truncated", (F.col("block") == F.min("block").over(own)).alias("first"), (F.col("block") == F.max("block").over(own)).alias("last"),
    )


_SEGMENT = [
    ("conv_id", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("codes", pa.string()), ("initials", pa.string()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()),
]
_SEGMENT_DDL = "conv_id long, block long, start long, codes string, initials string, blank long, duplicate long, truncated long, first boolean, last boolean"
_BEST = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("exit", pa.int64())]))


def chosen(found: DataFrame) -> DataFrame:
    """``segments`` with their cost, audit, marks of rows, and the pairs of neighbouring initials that may not follow each other."""
    crossed_ddl = _SEGMENT_DDL + ", crossing array<long>"

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                costs = crossing_costs(part.column("codes").to_pylist()).reshape(-1, 16)
                yield part.append_column("crossing", pa.array(list(costs), pa.list_(pa.int64())))

    def backward(rows: Iterator[dict]) -> Iterator[dict]:
        exits: list[int] = ENDS
        for row in rows:
            exits = ENDS if row["last"] else exits
            yield row | {"exits": exits}
            crossing = np.array(row.pop("crossing")).reshape(4, 4)
            exits = (crossing + np.array(exits)).min(axis=1).tolist()

    def searched(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            exits = None if row["last"] else row["exits"]
            tried = [cheapest(row["codes"], entry, exits) if entry == START or not row["first"] else None for entry in range(4)]
            row["best"] = [t and dict(zip(("cost", "audit", "exit"), t)) for t in tried]
            del row["exits"]
            yield row

    def forward(rows: Iterator[dict]) -> Iterator[dict]:
        state, before = START, ""
        for row in rows:
            if row["first"]:
                state, before = START, ""
            best, line = row.pop("best")[state], before + row["initials"]
            row["illegal"] = sum(line[i : i + 2] not in ("su", "ua", "au") for i in range(len(line) - 1))
            row["cost"], row["audit"], row["marks"] = best["cost"], best["audit"], row_marks(row["codes"], best["audit"], state)
            state, before = best["exit"], line[-1]
            yield row

    exits = pa.schema([*_SEGMENT, ("exits", pa.list_(pa.int64()))])
    best = pa.schema([*_SEGMENT, ("best", _BEST)])
    out = pa.schema([*_SEGMENT, ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("marks", pa.list_(pa.string()))])
    tables = found.mapInArrow(cross, crossed_ddl)
    ahead = carried(tables, "conv_id", [F.desc("block")], backward, exits, _SEGMENT_DDL + ", exits array<long>")
    tried = ahead.mapInArrow(lambda batches: emit(searched(rows_of(batches)), best), _SEGMENT_DDL + ", best array<struct<cost: long, audit: string, exit: long>>")
    return carried(tried, "conv_id", ["block"], forward, out, _SEGMENT_DDL + ", illegal long, cost long, audit string, marks array<string>")


def repair(rows: DataFrame) -> Repair:
    """The repair of all conversations in ``rows`` (conv_id, turn, role, text)."""
    rows = ordered(rows)
    found = written(chosen(segments(rows)), "segments")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    report = found.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in sums), audit.alias("audit"), F.lit(None).cast("long").alias("gaps"))
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    gaps = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(gap.alias("gaps"))
    both = report.unionByName(gaps, allowMissingColumns=True).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ["gaps", *sums, "audit"]))
    marks = found.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "marks"))), lambda x: x["marks"])).alias("marks"))
    mark = F.get("marks", F.col("at").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int"))
    one = rows.withColumn("block", _block(F.col("at"))).join(marks, "block").withColumn("mark", mark).where("mark <> 'D'")
    each = one.select("conv_id", "at", "role", "text", F.posexplode(F.split("mark", "")).alias("place", "edit")).where("edit <> 'D'")
    made = F.col("edit").isin("u", "a")
    turns = each.select(
        "conv_id", "at", "place", F.when(F.lower("edit") == "u", "user").when(F.lower("edit") == "a", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(made, "").otherwise(F.col("text")).alias("text"), F.when(made, "I").when(F.col("edit") == "K", "K").otherwise("R").alias("edit"),
    )
    return Repair(both, turns)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``: dropped, emptied, without stops, repeated or said by the user."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    told = rows.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), kind.alias("kind")).where("kind <> 0")
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` of each conversation's turns, joined by newlines; a conversation streams through one task, as the hash demands."""

    def digest(rows: Iterator[dict]) -> Iterator[dict]:
        now, running, any_row = None, None, False
        for row in rows:
            if any_row and row["conv_id"] == now:
                running.update(b"\n")
            else:
                if any_row:
                    yield {"conv_id": now, "repaired_sha256": running.hexdigest()}
                now, running, any_row = row["conv_id"], hashlib.sha256(), True
            running.update(f"{row['role']}:{row['text']}".encode())
        if any_row:
            yield {"conv_id": now, "repaired_sha256": running.hexdigest()}

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return carried(turns.select("conv_id", "at", "place", "role", "text"), "conv_id", ["at", "place"], digest, schema, "conv_id long, repaired_sha256 string")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: the report on its damaged rows and the digest of their repair."""
    done = repair(damaged(conversations))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    parts = done.report.unionByName(turn_digests(done.turns), allowMissingColumns=True).unionByName(ids, allowMissingColumns=True)
    return parts.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
