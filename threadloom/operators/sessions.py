"""Session-level tables derived from messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import predicates as P
from threadloom.functions.text import truncate


def sessions(messages: DataFrame) -> DataFrame:
    """One row for each session: title (head of the first prompt), certified turns, rows and characters."""
    prompt = F.when(F.col("kind") == "prompt", F.struct("msg_idx", "text"))
    return messages.groupBy("session_id").agg(
        truncate(F.min(prompt)["text"], 80).alias("title"),
        F.count_if(P.is_turn(F.col("kind"), F.col("role"))).alias("message_count"), F.count("*").alias("n_rows"),
        F.sum(F.char_length("text")).cast("long").alias("n_chars"),
    )


def find(sessions_: DataFrame, wanted: str) -> DataFrame:
    """The session with this id, else the only one whose id starts with it; an ambiguous prefix is an error."""
    exact = sessions_.where(F.col("session_id") == wanted)
    if not exact.isEmpty():
        return exact
    some = sessions_.where(F.startswith("session_id", F.lit(wanted)))
    if some.limit(2).count() > 1:
        raise ValueError(f"{wanted} is ambiguous")
    return some


def preferred(rows: DataFrame, key: list[str], rank: list) -> DataFrame:
    """One row for each key: the first in the order ``rank``."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*rank))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def listing(rows: DataFrame, by: str, limit: int = 40, newest_first: bool = True) -> DataFrame:
    """The ``limit`` largest by ``by`` (nulls last, ties by id), largest first or in reverse."""
    top = rows.orderBy(F.col(by).desc_nulls_last(), "session_id").limit(limit)
    return top if newest_first else top.orderBy(F.col(by).asc_nulls_first(), F.col("session_id").desc())


def window_of(messages: DataFrame, first: int | None = None, last: int | None = None, span: tuple[int, int] | None = None, around: int | None = None, context: int = 5) -> DataFrame:
    """Rows of each session: the first or last n, a range (end exclusive), or those around an index."""
    if first is not None:
        return messages.where(F.col("msg_idx") < first)
    if span is not None:
        return messages.where((F.col("msg_idx") >= span[0]) & (F.col("msg_idx") < span[1]))
    if around is not None:
        return messages.where(F.col("msg_idx").between(around - context, around + context))
    if last is not None:
        back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("msg_idx").desc()))
        return messages.withColumn("_at", back).where(F.col("_at") <= last).drop("_at")
    return messages


def within_budget(messages: DataFrame, size, budget: int, newest: bool = False) -> DataFrame:
    """Messages from one end of each session while their summed ``size`` fits ``budget``; the first always stays."""
    order = F.col("msg_idx").desc() if newest else F.col("msg_idx")
    by = Window.partitionBy("session_id").orderBy(order)
    held = messages.withColumn("_sum", F.sum(size).over(by)).withColumn("_at", F.row_number().over(by))
    return held.where((F.col("_sum") <= budget) | (F.col("_at") == 1)).drop("_sum", "_at")


#: flags by the event kinds, affordances or message kinds that set them
FLAGS = {
    "errors": ["error"], "edits": ["file_edit"], "reads": ["file_read"], "commands": ["command"], "searches": ["search"], "subagents": ["subagent_spawn"],
    "messages": ["agent_message"], "background": ["background", "background_job"], "plan": ["plan"], "skills": ["skill"], "questions": ["question"],
    "schedules": ["schedule"], "compactions": ["compaction_boundary", "compaction_summary"], "images": ["image"], "workflows": ["workflow"],
    "compacted": ["compaction_boundary", "compaction_summary"], "goal": ["goal"], "schedule": ["schedule"], "background_job": ["background_job"],
    "subagent_spawn": ["subagent_spawn"], "subagent_return": ["subagent_return"], "skill": ["skill"], "hook": ["hook"], "question": ["question"], "approval": ["approval"],
    "checkpoint": ["checkpoint"], "branch": ["branch"], "fork": ["fork"], "model_change": ["model_change"],
}


def flags(events: DataFrame) -> DataFrame:
    """(session_id, has_...) of ``events`` (session_id, kind): one flag for each of ``FLAGS``, and has_tools for any call but an error."""
    kind = F.col("kind")
    any_ = [F.coalesce(F.bool_or(kind.isin(kinds)), F.lit(False)).alias(f"has_{name}") for name, kinds in FLAGS.items()]
    return events.groupBy("session_id").agg(*any_, F.coalesce(F.bool_or(kind != "error"), F.lit(False)).alias("has_tools"))


def touching(events: DataFrame, needle: str) -> DataFrame:
    """(session_id) of sessions that edit or read a target that holds the needle."""
    hit = F.col("kind").isin("file_edit", "file_read") & F.contains(F.lower("target"), F.lit(needle.lower()))
    return events.where(hit).select("session_id").distinct()


def through_children(rows: DataFrame, test: Column) -> DataFrame:
    """(session_id) of the parents of ``rows`` (session_id, parent_id, ...) that pass: sub-agent types, workflow runs."""
    return rows.where(F.coalesce(test, F.lit(False)) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("session_id")).distinct()


def subtool(events: DataFrame, tool: str) -> DataFrame:
    """(session_id) of sessions whose sub-agents use a tool that they don't use themselves (events: session_id, parent_id, tool)."""
    used = F.contains(F.lower("tool"), F.lit(tool.lower()))
    own = events.where(used).select("session_id").distinct()
    return through_children(events, used).join(own, "session_id", "left_anti")


def newest_within(rows: DataFrame, when: str, size: str, budget: int) -> DataFrame:
    """``rows`` from the newest on while their sizes together stay within ``budget``; ties and null times come last, by id.

    Days are summed first, so only the rows of the day at which the budget ends are put in one order.
    """
    day = F.coalesce(F.to_date(when), F.lit("0001-01-01").cast("date"))
    dated = rows.withColumn("_day", day)
    days = dated.groupBy("_day").agg(F.sum(size).alias("_own"))
    upto = days.select("_day", (F.sum("_own").over(Window.orderBy(F.col("_day").desc())) - F.col("_own")).alias("_before"), "_own")
    placed = dated.join(upto, "_day").where(F.col("_before") < budget)
    whole = placed.where(F.col("_before") + F.col("_own") <= budget)
    last = placed.where(F.col("_before") + F.col("_own") > budget)
    order = Window.partitionBy("_day").orderBy(F.col(when).desc_nulls_last(), "id")
    cut = last.withColumn("_at", F.col("_before") + F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_at") <= budget)
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))


def using(events: DataFrame, tool: Column, by: str = "session_id") -> DataFrame:
    """(by) of the sessions with an event that passes the test."""
    return events.where(F.coalesce(tool, F.lit(False))).select(by).distinct()


def having(rows: DataFrame, facts: DataFrame, on: Column) -> DataFrame:
    """``rows`` with at least one of ``facts``: membership, each row once."""
    return rows.join(facts, on, "left_semi")


def overview(messages: DataFrame, first: int, last: int) -> DataFrame:
    """(session_id, msg_idx, omitted): the first and last rows of each session, and how many lie between.

    Sessions are numbered from 0 without gaps, so their size is one row each and no window holds a long one.
    """
    sizes = messages.groupBy("session_id").agg(F.count("*").alias("_n"))
    at = F.col("msg_idx")
    kept = messages.join(sizes, "session_id").where((at < first) | (at >= F.col("_n") - last))
    return kept.select("session_id", "msg_idx", F.greatest(F.col("_n") - first - last, F.lit(0)).alias("omitted"))


def timeline(events: DataFrame, when: str, ties: list[str], limit: int) -> DataFrame:
    """The first ``limit`` events by time, then by ``ties``; those without a time come last."""
    return events.orderBy(F.col(when).asc_nulls_last(), *ties).limit(limit)


def top_of(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows in ``order`` with ``total``, how many there are."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total))
