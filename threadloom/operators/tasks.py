"""Folding a task event log into the state of each task.

Events (id, task_id, ts, by, event, payload as JSON) apply in the order of their ids. An
event that comes again with the same content changes nothing; another content under a known
id, or a transition that the state doesn't allow, marks the task's ``error`` and ends its fold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import actor
from threadloom.session import together

# States, and event tags that are read but change nothing.
OPEN, CLAIMED, DONE, ABANDONED, SUPERSEDED, RESOLVED = "open", "claimed", "done", "abandoned", "superseded", "resolved"
TERMINAL = {DONE, ABANDONED, SUPERSEDED, RESOLVED}
RETIRED = {"revision_proposed", "review_rerouted", "review_passed", "review_refuted", "source_unavailable", "merge_failed", "merged_local", "reconcile_failed", "landed"}

SCHEMA = "task_id string, state string, title string, assignee string, tags array<string>, blocked_by array<string>, options array<string>, choice string, provisional boolean, status string, revisions int, notes int, error string"
_ARROW = pa.schema([
    *((n, pa.string()) for n in ("task_id", "state", "title", "assignee")), *((n, pa.list_(pa.string())) for n in ("tags", "blocked_by", "options")),
    ("choice", pa.string()), ("provisional", pa.bool_()), ("status", pa.string()), ("revisions", pa.int32()), ("notes", pa.int32()), ("error", pa.string()),
])


_COLUMNS = ["task_id", "id", "ts", "by", "event", "payload"]
_SLICE = 4096


def folded(rows: Iterator[tuple]) -> Iterator[dict]:
    """The state of each task of (task_id, id, ts, by, event, payload), which come task by task in the order of their ids; only one event is held."""
    task, last = None, None
    for task_id, *event in rows:
        if task is None or task_id != task["task_id"]:
            if task:
                yield task
            task, last = dict(task_id=task_id, state=None, title=None, assignee=None, tags=[], blocked_by=[], options=[], choice=None, provisional=None, status=None, revisions=0, notes=0, error=None), None
        if task["error"] or event == last:
            continue
        id_, _, _, kind, payload = event
        if last and id_ == last[0]:
            task["error"] = f"{id_}: another event has this id"
            continue
        last = event
        wrong = step(task, kind, json.loads(payload) if payload else {})
        if wrong:
            task["error"] = f"{id_}: {wrong}"
    if task:
        yield task


def fold_one(events: pd.DataFrame) -> dict:
    """The state of one task after its events, which are in the order of their ids."""
    return next(folded(events[_COLUMNS].itertuples(index=False, name=None)))


def step(task: dict, event: str, p: dict) -> str | None:
    """Applies one event; what forbids it, if anything does."""
    state = task["state"]
    if event in RETIRED:
        return None
    if event == "opened":
        if state:
            return "opened twice"
        task.update(state=OPEN, title=p.get("title"), assignee=p.get("assignee"))
        return None
    if not state:
        return "not open yet"
    if event == "noted":
        task["notes"] += 1
    elif event == "status_set":
        task["status"] = p.get("text")
        task["revisions"] += 1
    elif event == "tagged":
        task["tags"] += [t for t in p.get("tags", []) if t not in task["tags"]]
    elif event == "blocked_by":
        if p.get("task") not in task["blocked_by"]:
            task["blocked_by"].append(p.get("task"))
    elif event == "posed":
        if task["options"]:
            return "posed twice"
        if p.get("default") not in p.get("options", []):
            return "the default isn't an option"
        task["options"] = p["options"]
    elif event == "resolved":
        if not task["options"] or p.get("choice") not in task["options"]:
            return "no such choice"
        if state == RESOLVED and not task["provisional"]:
            return "resolved already"
        task.update(state=RESOLVED, choice=p["choice"], provisional=bool(p.get("provisional", False)))
    elif state in TERMINAL:
        return f"{event} after {state}"
    elif event == "claimed":
        task.update(state=CLAIMED, assignee=p.get("assignee"))
    elif event == "released":
        task.update(state=OPEN, assignee=None)
    elif event in ("done", "abandoned", "superseded"):
        task["state"] = event
    else:
        return f"unknown event {event}"
    return None


def fold_tasks(events: DataFrame) -> DataFrame:
    """One row for each task. Sorted events stream by, many tasks to a task of Spark; a log of any length is held one event at a time."""
    order = ["task_id", F.col("id").asc_nulls_last(), "ts", "by", "event", "payload"]
    dealt = together(events.select(*_COLUMNS), "task_id").sortWithinPartitions(*order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for k in range(0, batch.num_rows, _SLICE) for r in zip(*(c.to_pylist() for c in batch.slice(k, _SLICE).columns)))
        tasks = folded(rows)
        while held := list(islice(tasks, _SLICE)):
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    return dealt.mapInArrow(fold, SCHEMA)


def blocked(tasks: DataFrame) -> DataFrame:
    """(task_id, is_blocked): whether any blocker is missing or not in a final state."""
    wanted = tasks.select("task_id", F.explode_outer("blocked_by").alias("blocker"))
    states = tasks.select(F.col("task_id").alias("blocker"), F.col("state").alias("blocker_state"))
    open_ = F.col("blocker").isNotNull() & ~F.coalesce(F.col("blocker_state").isin(*sorted(TERMINAL)), F.lit(False))
    return wanted.join(states, "blocker", "left").groupBy("task_id").agg(F.bool_or(open_).alias("is_blocked"))


# What the payload of an event must hold.
NEEDS = {
    "opened": ["title"], "status_set": ["text"], "tagged": ["tags"], "blocked_by": ["task"], "posed": ["options", "default"], "resolved": ["choice"],
    "claimed": ["assignee"], "noted": [], "released": [], "done": [], "abandoned": [], "superseded": [],
}


def shape_error(event: Column, payload: Column, task_id: Column) -> Column:
    """What is wrong with an event by itself, before any state is asked, or null."""
    wrong = F.when(task_id.isNull(), F.lit("no task")).when(~F.coalesce(event.isin([*NEEDS, *sorted(RETIRED)]), F.lit(False)), F.lit("unknown event"))
    for name, keys in NEEDS.items():
        for key in keys:
            wrong = wrong.when((event == name) & F.get_json_object(payload, f"$.{key}").isNull(), F.lit(f"no {key}"))
    return wrong


def listed(tasks: DataFrame, states: list[str] | None = None, assignee: str | None = None, tag: str | None = None, decisions: bool | None = None, since: Column | None = None) -> DataFrame:
    """The tasks that pass all filters given; ``since`` is a test of the caller's columns."""
    test = F.lit(True)
    if states:
        test = test & F.col("state").isin(states)
    if assignee:
        test = test & (F.col("assignee") == assignee)
    if tag:
        test = test & F.array_contains("tags", tag)
    if decisions is not None:
        test = test & ((F.size("options") > 0) == decisions)
    if since is not None:
        test = test & since
    return tasks.where(F.coalesce(test, F.lit(False)))


#: why a task is in an inbox, the most urgent first
REASONS = ("decision_owed", "discussing", "provisional", "assigned_open", "claimed")
DISCUSS = "discuss"


def _waiting() -> tuple[Column, Column]:
    """(whether a provisional choice awaits its veto, whether the task is closed for good) of a task."""
    veto = F.coalesce((F.col("state") == RESOLVED) & F.col("provisional"), F.lit(False))
    return veto, F.col("state").isin(*sorted(TERMINAL)) & ~veto


def inbox_reason() -> Column:
    """struct(reason, since) of a task for its assignee: one of ``REASONS`` and when the wait began; null if nothing is owed."""
    state = F.col("state")
    veto, _ = _waiting()
    live = ~state.isin(*sorted(TERMINAL))
    decision = live & (F.coalesce(F.size("options"), F.lit(0)) > 0)
    parked = F.coalesce(F.array_contains("tags", DISCUSS), F.lit(False))

    def owed(reason: str, since: str) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.coalesce(F.col(since), F.col("last_ts")).alias("since"))

    return (
        F.when(veto, owed("provisional", "resolved_at")).when(decision & parked, owed("discussing", "last_ts")).when(decision, owed("decision_owed", "posed_at"))
        .when(state == OPEN, owed("assigned_open", "last_ts")).when(state == CLAIMED, owed("claimed", "last_ts"))
    )


def inboxes(tasks: DataFrame, since: Column | None = None, caller: str | None = None, unread_only: bool = False) -> DataFrame:
    """What each assignee has before them: (who, task_id, section, reason, since, unread, title) of tasks
    (task_id, title, state, assignee, tags, options, provisional, last_by, last_ts, posed_at, resolved_at).

    ``section`` is open, hidden (older than ``since`` and not the caller's affair) or closed; ``web:x`` and ``x`` are one actor. A task is unread if
    another wrote its last event. All inboxes come from one pass without a shuffle; sort open ones by ``since``, closed ones by it in reverse.
    """
    who = actor(F.col("assignee"))
    _, closed = _waiting()
    owed = F.when(~closed, inbox_reason())
    by = F.coalesce(actor(F.col("last_by")), F.lit(""))
    concerns = F.coalesce((who == caller) | (by == caller), F.lit(False)) if caller is not None else F.lit(False)
    current = F.coalesce(F.col("last_ts") >= since, F.lit(False)) | concerns if since is not None else F.lit(True)
    section = F.when(closed & current, "closed").when(owed.isNotNull() & current, "open").when(owed.isNotNull(), "hidden")
    found = tasks.where("assignee IS NOT NULL").select(who.alias("who"), "task_id", "title", section.alias("section"), owed["reason"].alias("reason"), F.coalesce(owed["since"], F.col("last_ts")).alias("since"), (by != who).alias("unread"))
    kept = F.col("section").isNotNull()
    return found.where(kept & ((F.col("section") != "open") | F.col("unread")) if unread_only else kept)


def inbox_counts(items: DataFrame) -> DataFrame:
    """(who, a column for each of ``REASONS``, unread, closed, hidden, oldest) of ``inboxes``; only open items count for reasons and unread."""
    open_ = F.col("section") == "open"
    return items.groupBy("who").agg(
        *[F.count_if(open_ & F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in REASONS], F.count_if(open_ & F.col("unread")).alias("unread"),
        F.count_if(F.col("section") == "closed").alias("closed"), F.count_if(F.col("section") == "hidden").alias("hidden"), F.min(F.when(open_, F.col("since"))).alias("oldest"),
    )


def inbox_page(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items of each section of each inbox, with their ``place``: open and hidden ones the longest waiting first, closed ones the newest first; ties by id.

    Each task's own candidates are cut to ``n`` before one order is made, so an inbox that holds a third of all tasks isn't sorted in one task.
    """
    from pyspark.sql import Window

    at = F.unix_micros(F.col("since").cast("timestamp"))
    held = items.withColumn("_key", F.when(F.col("section") == "closed", -at).otherwise(at)).withColumn("_part", F.pmod(F.xxhash64("task_id"), F.lit(64)))
    order = [F.col("_key").asc_nulls_last(), "task_id"]
    first = F.row_number().over(Window.partitionBy("who", "section", "_part").orderBy(*order))
    cut = held.withColumn("_at", first).where(F.col("_at") <= n)
    return cut.withColumn("place", F.row_number().over(Window.partitionBy("who", "section").orderBy(*order))).where(F.col("place") <= n).drop("_key", "_part", "_at")


def selected_events(events: DataFrame, after: Column, kinds: list[str] | None = None, by: Column | None = None) -> DataFrame:
    """Events behind an exclusive cursor (``after``, a test), of some kinds, by or not by some actors (``by``, a test); a test that is null fails."""
    test = F.coalesce(after, F.lit(False))
    if kinds is not None:
        test = test & F.coalesce(F.col("event").isin(kinds), F.lit(False))
    if by is not None:
        test = test & F.coalesce(by, F.lit(False))
    return events.where(test)
