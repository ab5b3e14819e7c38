"""Distilling long sessions: brief, timeline, facts, ledger, a tail kept as it is, and a sidecar of what went.

``messages`` have session_id, msg_idx (from 0 without gaps), role, kind, text, calls (id, name, input as JSON) and
results (id, content, failed). Everything is a projection or an aggregate of them; only the cut and the ledger's
runs need a session's rows in order, in windows that spill.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.aggregates import merged_ranges
from threadloom.operators.tools import first_of, operation
from threadloom.session import written

CALLS = "array<struct<id: string, name: string, input: string>>"
RESULTS = "array<struct<id: string, content: string, failed: boolean>>"

#: kinds of messages that say something to the agent besides prompts
INCOMING = ["prompt", "peer_message", "subagent_return", "compaction_summary", "error"]
# What a commit, a branch, a remote target, a test run, its verdict and an error look like.
COMMIT = r"(?m)^\[([^\]\s]+)(?: \([^)]*\))? ([0-9a-f]{7,40})\] (.+)$"
ON_BRANCH = r"(?m)^On branch (\S+)"
REMOTE = r"(?:^|\s)((?:[\w.-]+@)?[\w.-]+):[/~]"
SSH = r"\bssh\s+(?:-\S+\s+)*((?:[\w.-]+@)?[\w.-]+)"
GATE = r"\bcargo\s+(?:build|test|nextest|check|clippy)\b|\bmake\b|\bpytest\b|\bnpm\s+(?:run\s+)?test\b|\bgo\s+test\b|\bctest\b|\bninja\b"
VERDICT = r"(?i)\berror\b|\bfail|\bpassed\b|\bsuccess|\bcompleted\b|\brc=\d|exit code|\bbuilt\b|test result"
ERROR_LINE = r"(?i)\berror\b|\bfatal\b|denied|no such file|not found|cannot|can't|failed|refused|timed out|unknown|invalid|conflict|panicked|traceback"
PROSE = r"(?i)\.(?:md|txt|rst|adoc)$"


class Distilled(NamedTuple):
    """brief (session_id, text); timeline (session_id, msg_idx, part, what, label, text); facts (session_id, kind, value, detail, n, last);
    ledger (session_id, first, last, n, label, outcome); tail (messages); elided (session_id, msg_idx, call_id, tool, input, content); stats."""

    brief: DataFrame
    timeline: DataFrame
    facts: DataFrame
    ledger: DataFrame
    tail: DataFrame
    elided: DataFrame
    stats: DataFrame


def head_tail(text: Column, most: int, pointer: Column) -> Column:
    """``text`` of at most ``most`` bytes: three fifths of it from the head, the rest from the tail, whole characters, and what lies between counted."""
    head, tail = most * 3 // 5, most - most * 3 // 5
    data = text.cast("binary")
    part = lambda start, n: F.make_valid_utf8(F.substring(data, start, n).cast("string"))
    first = F.regexp_replace(part(1, head), "�\\z", "") if head else F.lit("")
    last = F.regexp_replace(part(-tail, tail), "\\A�+", "") if tail else F.lit("")
    gone = F.octet_length(text) - F.octet_length(first) - F.octet_length(last)
    whole = F.concat(first, F.lit("\n[… "), gone.cast("string"), F.lit(" bytes elided — "), pointer, F.lit(" …]\n"), last)
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def calls_of(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, part, call_id, tool, input, op, target) of every call."""
    each = messages.select("session_id", "msg_idx", F.posexplode("calls").alias("part", "call"))
    did = operation(F.col("call.name"), F.col("call.input"))
    return each.select("session_id", "msg_idx", "part", F.col("call.id").alias("call_id"), F.col("call.name").alias("tool"), F.col("call.input").alias("input"), did.alias("did")).select(
        "session_id", "msg_idx", "part", "call_id", "tool", "input", "did.op", "did.target"
    )


def results_of(messages: DataFrame) -> DataFrame:
    """(session_id, result_idx, call_id, content, failed); of several results of a call the last."""
    each = messages.select("session_id", F.col("msg_idx").alias("result_idx"), F.explode("results").alias("r"))
    last = each.groupBy("session_id", F.col("r.id").alias("call_id")).agg(F.max_by(F.struct("result_idx", "r.content", "r.failed"), "result_idx").alias("r"))
    return last.select("session_id", "r.result_idx", "call_id", F.coalesce("r.content", F.lit("")).alias("content"), F.coalesce("r.failed", F.lit(False)).alias("failed"))


def cuts(messages: DataFrame, keep_last: int) -> DataFrame:
    """(session_id, prompt, start, n): where each session's tail starts.

    The tail holds the last ``keep_last`` calls, with the whole run of the agent's messages that it begins in, never the
    first prompt, and no result without its call: ranges from calls to their results and runs of
    the agent's messages are merged, and a start inside one moves to its begin.
    """
    own = F.when(F.col("role") == "assistant", F.coalesce(F.size("calls"), F.lit(0))).otherwise(0)
    rows = messages.select("session_id", "msg_idx", "role", "kind", own.alias("n_calls"))
    back = Window.partitionBy("session_id").orderBy(F.col("msg_idx").desc())
    rows = rows.withColumn("after", F.sum("n_calls").over(back))
    at, does = F.col("msg_idx"), F.col("n_calls") > 0
    first = rows.groupBy("session_id").agg(
        F.max(F.when(does & (F.col("after") >= keep_last), at)).alias("enough"), F.min(F.when(does, at)).alias("some"), (F.max(at) + 1).alias("n"),
        F.min(F.when((F.col("role") == "user") & (F.col("kind") == "prompt"), at)).alias("prompt"),
    )
    if keep_last == 0:
        return first.select("session_id", "prompt", F.col("n").alias("start"), "n")
    first = first.withColumn("raw", F.coalesce("enough", "some", "n")).withColumn("least", F.coalesce(F.col("prompt") + 1, F.lit(0)))
    known = rows.join(first.select("session_id", "raw", "prompt"), "session_id").groupBy("session_id").agg(
        F.coalesce(F.max(F.when((F.coalesce("role", F.lit("")) != "assistant") & (at < F.col("raw")), at)) + 1, F.lit(0)).alias("begun"),
        F.min(F.when((F.col("role") == "assistant") & (at > F.col("prompt")), at)).alias("answer"),
    )
    start = F.when(F.col("begun") <= F.col("prompt"), F.coalesce("answer", "n")).otherwise(F.col("begun"))
    placed = first.join(known, "session_id").select("session_id", "prompt", "least", "n", start.alias("start"))
    said = rows.where("role = 'assistant'")
    run = said.select("session_id", (at - F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx"))).alias("run"), "msg_idx").groupBy("session_id", "run")
    runs = run.agg(F.min("msg_idx").alias("lo"), F.max("msg_idx").alias("hi")).select("session_id", "lo", "hi")
    pairs = calls_of(messages).select("session_id", "call_id", "msg_idx").join(messages.select("session_id", F.col("msg_idx").alias("result_idx"), F.explode("results").alias("r")).select("session_id", F.col("r.id").alias("call_id"), "result_idx"), ["session_id", "call_id"])
    spans = pairs.where("result_idx > msg_idx").groupBy("session_id", F.col("msg_idx").alias("lo")).agg((F.max("result_idx") - 1).alias("hi"))
    spans = spans.join(placed.select("session_id", "least"), "session_id").where("lo >= least").select("session_id", "lo", "hi")
    clipped = runs.join(placed.select("session_id", "least"), "session_id").where("hi >= least").select("session_id", F.greatest("lo", "least").alias("lo"), "hi")
    merged = merged_ranges(spans.unionByName(clipped), ["session_id"], "lo", "hi")
    moved = placed.join(merged, "session_id").where("lo < start AND start <= hi + 1").groupBy("session_id").agg(F.min("lo").alias("lo"))
    return placed.join(moved, "session_id", "left").select("session_id", "prompt", F.coalesce("lo", "start").alias("start"), "n")


def timeline(before: DataFrame, calls: DataFrame, note_max: int) -> DataFrame:
    """What was said to the agent and what it said, sent, noted and spawned, in order, from messages before the tail with their ``prompt``."""
    said = before.where("trim(text) <> ''")
    blank = F.lit(None).cast("string")
    to = said.where(F.col("kind").isin(INCOMING) & (F.coalesce("role", F.lit("")) != "assistant") & ~F.col("msg_idx").eqNullSafe(F.col("prompt")))
    incoming = to.select("session_id", "msg_idx", F.lit(-1).alias("part"), F.lit("to").alias("what"), F.col("kind").alias("label"), "text")
    own = said.where("role = 'assistant'").select("session_id", "msg_idx", F.lit(-1).alias("part"), F.lit("own").alias("what"), blank.alias("label"), "text")
    note = (F.col("op") == "file_edit") & F.col("target").rlike(PROSE)
    what = F.when(F.col("op") == "agent_message", "sent").when(F.col("op") == "subagent_spawn", "spawned").when(note, "note")
    text = first_of(F.col("input"), ["content", "message", "prompt", "text", "new_string"])
    short = F.when(F.col("what") == "sent", F.col("text")).otherwise(head_tail(F.col("text"), note_max, F.col("call_id")))
    done = calls.withColumn("what", what).where("what IS NOT NULL").withColumn("text", F.coalesce(text, F.lit("")))
    return incoming.unionByName(own).unionByName(done.select("session_id", "msg_idx", "part", "what", F.col("target").alias("label"), short.alias("text")))


def facts(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, kind, value, detail, n, last): commits, branches, hosts, paths, verdicts of test runs and errors, each once with its count and last place."""
    both = calls.join(results, ["session_id", "call_id"], "left")
    command = F.col("op") == "command"

    def found(rows: DataFrame, kind: str, value: Column, detail: Column) -> DataFrame:
        return rows.select("session_id", F.lit(kind).alias("kind"), value.alias("value"), detail.alias("detail"), "msg_idx")

    groups = lambda i: F.regexp_extract_all("content", F.lit(COMMIT), i)
    commit = both.where(command & F.contains("content", F.lit("]"))).select("session_id", "msg_idx", F.explode(F.arrays_zip(groups(2).alias("sha"), groups(1).alias("branch"), groups(3).alias("subject"))).alias("c"))
    each = lambda column, pattern: F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), 1)))
    branch = both.where(command).select("session_id", "msg_idx", each("content", ON_BRANCH).alias("v"))
    host = calls.where(command).select("session_id", "msg_idx", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("target", F.lit(SSH), 1), F.when(F.col("target").rlike(r"\b(?:scp|rsync)\b"), F.regexp_extract_all("target", F.lit(REMOTE), 1)).otherwise(F.array().cast("array<string>"))))).alias("v"))
    lines = F.split("content", "\r?\n")
    verdict = both.where(command & F.col("target").rlike(GATE)).withColumn("v", F.try_element_at(F.filter(lines, lambda x: x.rlike(VERDICT)), F.lit(-1)))
    error = both.where("failed").withColumn("v", F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(ERROR_LINE)), F.lit(0)), F.get(lines, F.lit(0))))
    none = F.lit(None).cast("string")
    rows = found(commit, "commit", F.col("c.sha"), F.concat(F.col("c.branch"), F.lit(" "), F.col("c.subject")))
    rows = rows.unionByName(found(branch, "branch", F.col("v"), none)).unionByName(found(host, "host", F.col("v"), none))
    rows = rows.unionByName(found(calls.where("op IN ('file_edit', 'file_read') AND target IS NOT NULL"), "path", F.col("target"), none))
    rows = rows.unionByName(found(verdict.where("v IS NOT NULL"), "verdict", F.col("target"), F.trim("v"))).unionByName(found(error, "error", F.trim("v"), F.col("tool")))
    place = F.struct("msg_idx", F.coalesce("detail", F.lit("")))
    return rows.groupBy("session_id", "kind", "value").agg(F.max_by("detail", place).alias("detail"), F.count("*").alias("n"), F.max("msg_idx").alias("last"))


def ledger(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, first, last, n, label, outcome): a line for each call, neighbouring repeats as one."""
    both = calls.join(results, ["session_id", "call_id"], "left")
    lines = F.split("content", "\r?\n")
    verdict = F.try_element_at(F.filter(lines, lambda x: x.rlike(VERDICT)), F.lit(-1))
    error = F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(ERROR_LINE)), F.lit(0)), F.get(lines, F.lit(0)))
    outcome = (
        F.when(F.col("content").isNull(), "no result").when(F.col("failed"), F.concat(F.lit("error: "), F.trim(error)))
        .when((F.col("op") == "command") & verdict.isNotNull(), F.trim(verdict)).otherwise(F.concat(F.octet_length("content").cast("string"), F.lit(" bytes")))
    )
    flat = F.regexp_replace(F.coalesce("target", F.lit("")), r"\s+", " ")
    label = F.when(flat == "", F.col("tool")).otherwise(F.concat(F.col("tool"), F.lit(" "), F.substring(flat, 1, 120)))
    order = Window.partitionBy("session_id").orderBy("msg_idx", "part")
    line = both.select("session_id", "msg_idx", "part", label.alias("label"), outcome.alias("outcome"))
    fresh = ~(F.lag("label").over(order).eqNullSafe(F.col("label")) & F.lag("outcome").over(order).eqNullSafe(F.col("outcome")))
    runs = line.withColumn("fresh", fresh).withColumn("run", F.count_if("fresh").over(order))
    return runs.groupBy("session_id", "run").agg(
        F.min("msg_idx").alias("first"), F.max("msg_idx").alias("last"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("outcome").alias("outcome")
    ).drop("run")


def distill(messages: DataFrame, keep_last: int = 12, tail_result_max: int = 6000, note_max: int = 6000) -> Distilled:
    """The parts of every session's distillate. Messages of no session are left out; a session without a prompt has no brief."""
    rows = messages.where("session_id IS NOT NULL").select(
        "session_id", "msg_idx", "role", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("calls", F.array()).cast(CALLS).alias("calls"),
        F.coalesce("results", F.array()).cast(RESULTS).alias("results"),
    )
    at = written(cuts(rows, keep_last), "cuts")  # a row a session, which every part reads
    placed = rows.join(at.select("session_id", "prompt", "start"), "session_id")
    before = placed.where("msg_idx < start")
    calls, results = calls_of(rows).join(at.select("session_id", "start"), "session_id"), results_of(rows)
    early = calls.where("msg_idx < start")
    brief = placed.where("msg_idx = prompt").select("session_id", "text")
    told = timeline(before, early, note_max)
    mined, book = facts(early, results), ledger(early, results)
    cap = lambda r: F.struct(r["id"].alias("id"), head_tail(r["content"], tail_result_max, F.coalesce(r["id"], F.lit(""))).alias("content"), r["failed"].alias("failed"))
    tail = placed.where("msg_idx >= start").select("session_id", "msg_idx", "role", "kind", "text", "calls", F.transform("results", cap).alias("results"))
    answered = calls.select("session_id", "call_id", "tool", "input", "start").join(results, ["session_id", "call_id"])
    elided = answered.where((F.col("result_idx") < F.col("start")) | (F.octet_length("content") > tail_result_max)).select("session_id", F.col("result_idx").alias("msg_idx"), "call_id", "tool", "input", "content")
    size = F.octet_length("text") + F.aggregate("calls", F.lit(0), lambda s, c: s + F.coalesce(F.octet_length(c["input"]), F.lit(0))) + F.aggregate("results", F.lit(0), lambda s, r: s + F.coalesce(F.octet_length(r["content"]), F.lit(0)))
    counted = placed.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.size("calls")).alias("tool_calls"), F.sum(F.when(F.col("msg_idx") >= F.col("start"), F.size("calls")).otherwise(0)).alias("tail_tool_calls"), F.sum(size).alias("source_bytes"), F.max("start").alias("tail_start"))
    tallies = [
        told.groupBy("session_id").agg(F.count("*").alias("timeline_entries")), elided.groupBy("session_id").agg(F.count("*").alias("elided_outputs")),
        mined.groupBy("session_id").agg(F.count_if(F.col("kind") == "commit").alias("commits"), F.sum(F.when(F.col("kind") == "error", F.col("n")).otherwise(0)).alias("errors")),
        tail.groupBy("session_id").agg(F.sum(size).alias("tail_bytes")),
    ]
    stats = counted
    for one in tallies:
        stats = stats.unionByName(one, allowMissingColumns=True)
    names = [c for c in stats.columns if c != "session_id"]
    return Distilled(brief, told, mined, book, tail, elided, stats.groupBy("session_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names)))
