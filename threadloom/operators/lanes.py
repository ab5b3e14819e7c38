"""Sub-agents as lanes: what they did, how they ended and who says so, what they still owe, and what a dead one left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graphs import ways_up
from threadloom.operators.sets import first_seen

#: seconds of silence after a final report from which a lane counts as returned; fractions of seconds count
QUIET = 600
DONE = ("completed", "done", "returned")
#: lanes with these states owe nothing: they still run, or are known to have failed
UNBOUND = ("running", "failed", "killed")


def lane_facts(events: DataFrame, by: str = "session_id") -> DataFrame:
    """(by, started, last_turn, duration_ms, last_tool, last_kind, tool_calls) of ``events`` (by, msg_idx, ts, tool, kind, call)."""
    found = events.groupBy(by).agg(
        F.min("ts").alias("started"), F.max("ts").alias("last_turn"), F.max_by("tool", "msg_idx").alias("last_tool"), F.max_by("kind", "msg_idx").alias("last_kind"), F.count_if("call").alias("tool_calls")
    )
    ms = F.unix_millis(F.col("last_turn").cast("timestamp")) - F.unix_millis(F.col("started").cast("timestamp"))
    return found.withColumn("duration_ms", ms)


def final_words(messages: DataFrame, by: str = "session_id") -> DataFrame:
    """(by, last_text, reported) of messages (by, msg_idx, role, text, calls): the last reply with text, and whether the session ends in it without a call."""
    said = (F.col("role") == "assistant") & (F.trim("text") != "")
    ends = said & (F.coalesce(F.size("calls"), F.lit(0)) <= 0) if "calls" in messages.columns else said
    return messages.groupBy(by).agg(F.max_by("text", F.when(said, F.col("msg_idx"))).alias("last_text"), F.coalesce(F.max_by(F.coalesce(ends, F.lit(False)), "msg_idx"), F.lit(False)).alias("reported"))


def open_tool_calls(calls: DataFrame, results: DataFrame, by: str = "session_id") -> DataFrame:
    """(by, open_tool_calls) of lanes with calls that no result answers."""
    return calls.join(results.select(by, "call_id").distinct(), [by, "call_id"], "left_anti").groupBy(by).agg(F.count("*").alias("open_tool_calls"))


def verdict(now: Column, quiet: int = QUIET) -> Column:
    """struct(status, source) of a lane's evidence; the first witness that speaks for the time after its last turn counts.

    Columns: journal (a workflow's result word), notice and notice_at (the parent's notification), stop_seen (whether the lane's own
    stop hook followed its last turn; null where none is recorded), parked (a word that came with it), exited and exit_at (the process),
    ledger_at (a stop in a ledger), reported (it ends in a report), last_turn. Any may be null.
    """
    c = F.col
    last, notice = c("last_turn"), c("notice")
    runs = notice.isin("working", "running")
    stopped = c("stop_seen").eqNullSafe(F.lit(True))
    # a notice against the lane's own stop record must be later than the last turn, any other may be of the same instant
    against = F.when(runs, stopped).otherwise(c("stop_seen").eqNullSafe(F.lit(False)) & ~notice.isin("killed", "failed"))
    timely = (
        F.when(c("notice_at").isNull(), stopped).when(last.isNull(), ~(runs & stopped)).when(against, c("notice_at") > last).otherwise(c("notice_at") >= last)
    )
    named = F.when(runs, "running").otherwise(notice)
    gone = F.coalesce(c("exited"), F.lit(False)) & F.coalesce(c("exit_at") >= last, F.lit(True))
    ledger = c("ledger_at").isNotNull() & F.coalesce(c("ledger_at") >= last, F.lit(True))
    reported = F.coalesce(c("reported"), F.lit(False))
    silent = F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) >= quiet * 1_000_000, F.lit(False))

    def says(status, by: str) -> Column:
        return F.struct((status if isinstance(status, Column) else F.lit(status)).alias("status"), F.lit(by).alias("source"))

    return (
        F.when(c("journal") != "", says(c("journal"), "journal")).when(notice.isNotNull() & timely, says(named, "task_notification"))
        .when(stopped, says(F.coalesce(F.when(c("parked") != "", c("parked")), F.lit("stopped")), "subagent_stop"))
        .when(gone, says(F.when(reported, "returned").otherwise("stopped"), "process_exit")).when(ledger, says("stopped", "hook_ledger"))
        .when(reported & silent, says("returned", "transcript")).otherwise(says("running", "transcript"))
    )


def obligations(lanes: DataFrame) -> DataFrame:
    """``lanes`` (session_id, parent_id, status, source, and counts open_tool_calls, open_tasks, open_decisions) with unreturned, stranded and finished.

    A lane is stranded if it neither runs nor failed but owes something or died in mid-turn. It is finished if its state says so and it isn't
    stranded, which needs every lane below it finished: so unfinished is whoever has an unfinished lane below, found by
    walking up from the lanes that are so by themselves, in as many joins as the logarithm of the depth. Links in a cycle end.
    """
    owes = sum((F.coalesce(F.col(n), F.lit(0)) for n in ("open_tool_calls", "open_tasks", "open_decisions")), F.lit(0)) > 0
    died = (F.col("source") == "process_exit") & (F.col("status") == "stopped")
    held = lanes.withColumn("_bound", ~F.col("status").isin(*UNBOUND)).withColumn("_owes", owes | F.coalesce(died, F.lit(False)))
    own = ~F.col("status").isin(*DONE) | F.col("_owes")
    links = lanes.where("parent_id IS NOT NULL").select(F.col("session_id").alias("id"), F.col("parent_id").alias("up"))
    undone = ways_up(links, held.where(own).select(F.col("session_id").alias("id"))).select(F.col("id").alias("session_id")).distinct()
    below = lanes.where("parent_id IS NOT NULL").join(undone, "session_id", "left_semi").groupBy(F.col("parent_id").alias("session_id")).agg(F.count("*").alias("unreturned"))
    out = held.join(below, "session_id", "left").withColumn("unreturned", F.coalesce("unreturned", F.lit(0)).cast("long"))
    stranded = F.col("_bound") & (F.col("_owes") | (F.col("unreturned") > 0))
    return out.withColumn("stranded", stranded).withColumn("finished", F.col("status").isin(*DONE) & ~F.col("stranded")).drop("_bound", "_owes")


def phase_tree(agents: DataFrame, phases: DataFrame, on: list[str]) -> DataFrame:
    """Agents below their phases: ``phases`` without agents stay, with null agent columns, and so do agents whose phase is unknown, marked ``orphan``."""
    known = phases.join(agents, on, "left").withColumn("orphan", F.lit(False))
    lost = agents.join(phases.select(*on), on, "left_anti").withColumn("orphan", F.lit(True))
    return known.unionByName(lost, allowMissingColumns=True)


def salvage(lanes: DataFrame, messages: DataFrame, events: DataFrame, every: bool = False) -> DataFrame:
    """(session_id, status, prompt, files, commands, last_note) of lanes that didn't finish, to take them up again.

    ``prompt`` is the whole first prompt; ``files`` the edited ones and ``commands`` the different command lines, each in the order in which they
    first came; ``last_note`` the last reply with text, where spaces of any kind are none. Prompts without text (null) are passed over.
    Repeats are dropped before a lane's lists are gathered.
    """
    wanted = lanes if every else lanes.where(~F.coalesce(F.col("status") == "done", F.lit(False)))
    wanted = wanted.select("session_id", "status")
    mine = messages.join(wanted.select("session_id"), "session_id", "left_semi")
    asked = F.when((F.col("kind") == "prompt") & F.col("text").isNotNull(), F.col("msg_idx"))
    note = F.when((F.col("role") == "assistant") & F.col("text").rlike(r"[^\p{Zs}]"), F.col("msg_idx"))
    talk = mine.groupBy("session_id").agg(F.min_by("text", asked).alias("prompt"), F.max_by("text", note).alias("last_note"))
    did = events.where("target IS NOT NULL").join(wanted.select("session_id"), "session_id", "left_semi")
    lists = {name: first_seen(did.where(F.col("kind") == kind), "session_id", "target", ["msg_idx"]).withColumnRenamed("seen", name) for name, kind in (("files", "file_edit"), ("commands", "command"))}
    out = wanted.join(talk, "session_id", "left")
    for name, found in lists.items():
        out = out.join(found, "session_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.select("session_id", "status", "prompt", "files", "commands", "last_note")
