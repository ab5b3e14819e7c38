"""What fills a model's context: tokens by source, tool and attachment, and the window since the last compaction.

Blocks are rows (session_id, msg_idx, role, kind, type, tokens, tool, call_id, attachment); only those of
messages that the model sees count. Nulls: a block without tokens weighs 0, a result that names no tool takes
the name of its call, or ``UNKNOWN`` if no call has its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import predicates as P
from threadloom.functions.tokens import BLOCK_TOKENS, IMAGE_TOKENS, block_tokens

UNKNOWN = "(unknown tool)"
CUTS = ("compaction_boundary", "compaction_summary")


def message_blocks(messages: DataFrame) -> DataFrame:
    """Block rows of ``messages`` as the readers give them (content: typed blocks), with estimated tokens."""
    b = F.col("b")
    kind = b["type"]
    tokens = (
        F.when(kind == "tool_use", block_tokens(b["input"], "tool_input")).when(kind == "tool_result", block_tokens(b["text"], "tool_result"))
        .when(kind == "image", F.lit(BLOCK_TOKENS + IMAGE_TOKENS)).otherwise(block_tokens(b["text"]))
    )
    spread = messages.select("session_id", "msg_idx", "role", "kind", F.explode("content").alias("b"))
    return spread.select(
        "session_id", "msg_idx", "role", "kind", kind.alias("type"), tokens.cast("long").alias("tokens"), b["name"].alias("tool"),
        F.coalesce(b["id"], b["tool_use_id"]).alias("call_id"), F.col("kind").alias("attachment"),
    )


def is_mcp(tool: Column) -> Column:
    return F.coalesce(F.startswith(tool, F.lit("mcp__")), F.lit(False))


def source(active: bool = False) -> Column:
    """The bucket of a block; summaries are one of their own in an active window and their role's text in a whole history."""
    role, kind, type_ = F.col("role"), F.col("kind"), F.col("type")
    text = F.when(kind == "injected_context", "attachments")
    if active:
        text = text.when(kind == "compaction_summary", "compaction_summary")
    text = text.when(role == "assistant", "assistant_text").when(role == "system", "system_text").otherwise("user_text")
    return F.when(type_ == "text", text).when(type_ == "thinking", "thinking").when(type_ == "tool_use", "tool_call_args").when(type_ == "tool_result", "tool_results").when(type_ == "image", "images")


def seen(blocks: DataFrame) -> DataFrame:
    return blocks.where(P.is_model_visible(F.col("kind"), F.col("role")))


def by_source(blocks: DataFrame, by: list[str] = (), active: bool = False) -> DataFrame:
    """(by, source, tokens, blocks)."""
    held = seen(blocks).withColumn("source", source(active)).where("source IS NOT NULL")
    return held.groupBy(*by, "source").agg(F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"), F.count("*").alias("blocks"))


def by_attachment(blocks: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, attachment, tokens) of what the harness put into prompts, by its own name for it, else the message kind."""
    held = seen(blocks).where("type = 'text' AND kind = 'injected_context'")
    name = F.coalesce("attachment", "kind")
    return held.groupBy(*by, name.alias("attachment")).agg(F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


def by_tool(blocks: DataFrame, by: list[str] = (), calls: DataFrame | None = None) -> DataFrame:
    """(by, tool, mcp, calls, result_tokens).

    Results without a name are summed by call id before they meet the calls, so a call polled many times joins
    once. ``calls`` gives the block rows in which names are looked up, where ``blocks`` are only part of a session.
    """
    rows = seen(blocks)
    own = ["session_id", *[c for c in by if c != "session_id"]]
    called = rows.where("type = 'tool_use'").select(*own, F.coalesce("tool", F.lit(UNKNOWN)).alias("tool"), F.lit(1).alias("calls"), F.lit(0).cast("long").alias("tokens"))
    results = rows.where("type = 'tool_result'")
    named = results.where("tool IS NOT NULL").select(*own, "tool", F.lit(0).alias("calls"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    owed = results.where("tool IS NULL").groupBy(*own, "call_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
    names = seen(calls if calls is not None else blocks).where("type = 'tool_use' AND call_id IS NOT NULL").groupBy("session_id", "call_id").agg(F.max_by("tool", "msg_idx").alias("tool"))
    found = owed.join(names, ["session_id", "call_id"], "left").select(*own, F.coalesce("tool", F.lit(UNKNOWN)).alias("tool"), F.lit(0).alias("calls"), "tokens")
    every = called.unionByName(named).unionByName(found)
    return every.groupBy(*by, "tool").agg(F.sum("calls").cast("long").alias("calls"), F.sum("tokens").cast("long").alias("result_tokens")).withColumn("mcp", is_mcp(F.col("tool")))


def active_window(rows: DataFrame) -> DataFrame:
    """``rows`` (session_id, msg_idx, id, parent_id, kind, ...) since each session's last compaction, with ``compacted``.

    The window begins after the last boundary; at the last summary if that is later and doesn't belong to the boundary,
    which it does if it stands next to it or names it as parent. Sessions are cut by one row each, so no window
    function holds a long session in one task.
    """
    at = lambda kind: F.when(F.col("kind") == kind, F.col("msg_idx"))
    b, s = at(CUTS[0]), at(CUTS[1])
    cuts = rows.where(F.col("kind").isin(*CUTS)).groupBy("session_id").agg(
        F.max(b).alias("_b"), F.max(s).alias("_s"), F.max_by("id", b).alias("_b_id"), F.max_by("parent_id", s).alias("_parent")
    )
    doubtful = cuts.where("_s > _b AND NOT coalesce(_parent = _b_id, false)").select("session_id", "_b", "_s")
    apart = rows.select("session_id", "msg_idx").join(doubtful, "session_id").where("msg_idx > _b AND msg_idx < _s").select("session_id").distinct()
    start = F.when(F.col("_b").isNull(), F.col("_s")).when(F.col("_apart"), F.col("_s")).otherwise(F.col("_b") + 1)
    starts = cuts.join(apart.withColumn("_apart", F.lit(True)), "session_id", "left").select("session_id", start.alias("_start"))
    return rows.join(starts, "session_id", "left").where("_start IS NULL OR msg_idx >= _start").withColumn("compacted", F.col("_start").isNotNull()).drop("_start")


def window_reports(rows: DataFrame) -> DataFrame:
    """One row for each session of ``rows`` (session_id, msg_idx, id, parent_id, role, kind, tokens, prompt_tokens, usage_key).

    ``tokens`` are those that a message shows, ``prompt_tokens`` the prompt size reported with it. Rows with one usage key
    are one response, which counts once, where it first stands, with its largest report. ``overhead`` is what the first
    report exceeds the tokens shown before it; ``burn`` the growth from the first to the last report, over ``steps`` responses.
    """
    window = active_window(rows).withColumn("tokens", F.when(P.is_model_visible(F.col("kind"), F.col("role")), F.coalesce("tokens", F.lit(0))).otherwise(0))
    key = F.coalesce(F.concat(F.lit("k"), F.col("usage_key")), F.concat(F.lit("m"), F.col("msg_idx").cast("string")))
    shown, role = P.is_model_visible(F.col("kind"), F.col("role")), F.col("role")
    readings = window.where("prompt_tokens > 0").groupBy("session_id", key.alias("_key")).agg(F.min("msg_idx").alias("_at"), F.max("prompt_tokens").alias("_read"))
    read = readings.groupBy("session_id").agg(
        F.min("_at").alias("_first_at"), F.min_by("_read", "_at").alias("first_prompt"), F.max_by("_read", "_at").alias("current"), F.max("_read").alias("peak"), F.count("*").alias("_n")
    )
    replies = window.where(shown & (role == "assistant")).select("session_id", key.alias("_key")).distinct().groupBy("session_id").agg(F.count("*").alias("_replies"))
    asked = shown & (role == "user") & P.is_exchange(F.col("kind"))
    sums = window.join(read.select("session_id", "_first_at"), "session_id", "left").groupBy("session_id").agg(
        F.bool_or("compacted").alias("compacted"), F.count("*").alias("messages"), F.count_if(asked).alias("_asked"), F.sum("tokens").cast("long").alias("total"),
        F.sum(F.when(F.col("msg_idx") < F.col("_first_at"), F.col("tokens")).otherwise(0)).cast("long").alias("_before"),
    )
    all_ = sums.join(read, "session_id", "left").join(replies, "session_id", "left")
    turns = F.when(F.col("_asked") > 0, F.col("_asked")).otherwise(F.coalesce("_replies", F.lit(1)))
    grew = (F.col("_n") >= 2) & (F.col("current") > F.col("first_prompt"))
    known = F.col("first_prompt").isNotNull()
    return all_.select(
        "session_id", "compacted", "messages", turns.cast("long").alias("turns"), "total", "first_prompt", F.when(known, F.col("_before")).alias("shown_before"),
        F.when(known, F.greatest(F.col("first_prompt") - F.col("_before"), F.lit(0))).cast("long").alias("overhead"), "current", F.coalesce("peak", F.lit(0)).alias("peak"),
        F.when(grew, F.col("current") - F.col("first_prompt")).otherwise(0).cast("long").alias("burn"), F.when(grew, F.col("_n") - 1).otherwise(0).cast("long").alias("steps"),
    )


def overall(reports: DataFrame) -> DataFrame:
    """One row over ``window_reports``: sums, the median overhead (halves cut off), and tokens burnt a turn, measured where any session grew, else estimated."""
    sums = reports.agg(
        F.count("*").alias("sessions"), F.count_if("compacted").alias("compacted"), F.sum("messages").cast("long").alias("messages"), F.sum("turns").cast("long").alias("turns"),
        F.sum("total").cast("long").alias("total"), F.max("peak").alias("peak"), F.floor(F.median("overhead")).cast("long").alias("overhead"), F.sum("burn").alias("_burn"), F.sum("steps").alias("_steps"),
    )
    rate = F.when(F.col("_steps") > 0, F.floor(F.col("_burn") / F.col("_steps"))).otherwise(F.floor(F.col("total") / F.col("turns")))
    return sums.withColumn("burn_per_turn", rate.cast("long")).drop("_burn", "_steps")


def profile(messages: DataFrame, what: list[str], tokens: str | None = None) -> DataFrame:
    """(what, name, messages, tokens) of messages by each of the columns ``what`` (role, kind, origin, cwd), '(none)' where it is null.

    One pass and one shuffle for all columns, of counts summed in the tasks.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("name")) for c in what])
    size = F.coalesce(F.col(tokens), F.lit(0)) if tokens else F.lit(0)
    spread = messages.select(F.explode(entries).alias("e"), size.alias("_tokens"))
    return spread.groupBy("e.what", "e.name").agg(F.count("*").alias("messages"), F.sum("_tokens").cast("long").alias("tokens"))
