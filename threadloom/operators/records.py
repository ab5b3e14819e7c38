"""Training records of whole sessions: structured tool calls, and one row for each human turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import predicates as P
from threadloom.functions.text import git_verb
from threadloom.operators.tools import COMMANDS, COMMAND_KEYS, first_of

MARKER = "[PRUNED id="


def training_role() -> Column:
    """The role a message trains as, by its kind; null if the model neither saw nor said it."""
    kind, role = F.col("kind"), F.col("role")
    by_kind = (
        F.when(kind.isin("system_prompt", "compaction_summary"), "system").when(kind.isin("injected_context", "prompt"), "user")
        .when(kind == "reply", "assistant").when(kind == "tool_result", "tool").when(kind.isin("subagent_spawn", "subagent_return"), role)
    )
    return F.when(P.is_model_visible(kind, role), by_kind)


def _texts(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda b: b["text"]), "\n\n")


def openai_tools(messages: DataFrame, reasoning: bool = True) -> DataFrame:
    """(session_id, record): one JSON record a session with ``tool_calls`` on assistant turns and a ``tool`` turn for each result.

    An assistant's calls carry the id, name and arguments as JSON text; content is null if it only calls. A call without an id gets ``call_<n>`` by its place
    in the session; a result without one is that of the earliest such call that none has answered, ``call_0`` if there is none. Texts that are null or blank are left out, and so
    are messages that hold nothing else. Images become ``[image]``.
    """
    visible = messages.withColumn("_role", training_role()).where("_role IS NOT NULL")
    parts = visible.select("session_id", "msg_idx", "_role", F.posexplode("content").alias("at", "b"))
    kind, text = F.col("b.type"), F.col("b.text")
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    nameless = F.coalesce(F.col("b.id"), F.lit("")) == ""
    ordered = Window.partitionBy("session_id").orderBy("msg_idx", "at")
    made = F.count_if((kind == "tool_use") & nameless).over(ordered)
    asked = F.count_if((kind == "tool_result") & (F.coalesce(F.col("b.tool_use_id"), F.lit("")) == "")).over(ordered)
    parts = parts.withColumn("_made", made).withColumn("_asked", asked)
    # only sessions that lack ids need the counts, but one sort serves all
    call_id = F.when(nameless, F.concat(F.lit("call_"), F.col("_made").cast("string"))).otherwise(F.col("b.id"))
    for_id = F.when(F.coalesce(F.col("b.tool_use_id"), F.lit("")) != "", F.col("b.tool_use_id")).when(F.col("_asked") <= F.col("_made"), F.concat(F.lit("call_"), F.col("_asked").cast("string"))).otherwise(F.lit("call_0"))
    call = F.when(kind == "tool_use", F.struct(call_id.alias("id"), F.lit("function").alias("type"), F.struct(F.col("b.name").alias("name"), F.coalesce("b.input", F.lit("{}")).alias("arguments")).alias("function")))
    said = F.when((kind == "text") & ~blank, text).when(kind == "image", F.lit("[image]"))
    thought = F.when((kind == "thinking") & ~blank, text) if reasoning else F.lit(None).cast("string")
    nothing = F.lit(None).cast("string")
    # a result is a turn of its own: before the rest of its message, or after the calls of an assistant's
    result = kind == "tool_result"
    turn = F.when(result & (F.col("_role") == "assistant"), F.col("at") + 1).when(result, F.col("at") - 1_000_000_000).otherwise(0)
    role = F.when(result, "tool").when(F.col("_role") == "tool", "user").otherwise(F.col("_role"))
    rows = parts.select("session_id", "msg_idx", turn.alias("_turn"), role.alias("role"), "at", said.alias("said"), thought.alias("thought"), call.alias("call"), F.when(result, for_id).alias("for_id"), F.when(result, F.coalesce(text, F.lit(""))).alias("result"))

    def listed(c: str) -> Column:
        """The known values of a turn in their order."""
        pairs = F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c))))
        return F.transform(pairs, lambda x: x[c])

    turns = rows.groupBy("session_id", "msg_idx", "_turn", "role").agg(listed("said").alias("said"), listed("thought").alias("thought"), listed("call").alias("calls"), F.max("for_id").alias("for_id"), F.max("result").alias("result"))
    turns = turns.where(F.col("for_id").isNotNull() | (F.size("said") > 0) | (F.size("thought") > 0) | (F.size("calls") > 0))
    content = F.when(F.col("for_id").isNotNull(), F.col("result")).when(F.size("said") > 0, F.array_join("said", "\n\n"))
    object_ = F.struct(
        "role", F.col("for_id").alias("tool_call_id"), content.alias("content"), F.when(F.size("thought") > 0, F.array_join("thought", "\n\n")).otherwise(nothing).alias("reasoning_content"),
        F.when(F.size("calls") > 0, F.col("calls")).alias("tool_calls"),
    )
    # null fields are left out; only a calling turn states its null content
    as_json = F.to_json(object_)
    as_json = F.when(content.isNull(), F.concat(F.lit('{"role":"assistant","content":null'), F.substr(as_json, F.lit(len('{"role":"assistant"') + 1)))).otherwise(as_json)
    one = turns.select("session_id", "msg_idx", "_turn", as_json.alias("turn"))
    gathered = F.sort_array(F.collect_list(F.struct("msg_idx", "_turn", "turn")))
    joined = F.array_join(F.transform(gathered, lambda x: x["turn"]), ",")
    return one.groupBy("session_id").agg(F.concat(F.lit('{"messages":['), joined, F.lit("]}")).alias("record"))


def cycle_rows(messages: DataFrame) -> DataFrame:
    """One row for each human turn after a session's first, with what stood before and came after it, in 20 columns.

    ``messages`` have (session_id, msg_idx, id, ts, role, kind, origin, text, content, and where known harness, cwd, queued). A human turn is a prompt of
    human origin with text; one that repeats the text of the last while either was queued is the same turn. ``report`` is the last reply text
    before it and ``plan`` the first after it, each with its time; ``proof`` says that the reader stated the turn, ``relayed`` that another agent
    passed it on. Tool counts, commits and pushes are those of the span between turns. Pruned texts aren't reports or plans.
    """
    for name, kind in (("harness", "string"), ("cwd", "string"), ("queued", "boolean")):
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(kind))
    own = Window.partitionBy("session_id").orderBy("msg_idx")
    human = (F.col("kind") == "prompt") & (F.col("origin") == "human") & (F.coalesce(F.trim("text"), F.lit("")) != "")
    # the last human turn before a row, whether or not it was a repeat: a repeat has the same text, and only a kept one sets the queue mark
    turns = messages.where(human).select("session_id", "msg_idx", "id", "ts", "text", F.coalesce("queued", F.lit(False)).alias("queued"))
    # what is kept depends on the one kept last; within a run of equal texts that is a repeat exactly where it or the run's last kept one is queued
    same = F.coalesce(F.lag("text").over(own) == F.col("text"), F.lit(False))
    runs = turns.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(own))
    in_run = Window.partitionBy("session_id", "_run").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    # once a queued one was kept every later one of the run repeats it; a run's first is always kept
    first = F.coalesce(F.first("queued").over(in_run), F.lit(False))
    begins = F.count("*").over(in_run) == 0
    kept = runs.withColumn("_kept", begins | ~(F.col("queued") | first)).where("_kept").drop("_run", "_kept")
    kept = kept.withColumn("_n", F.row_number().over(own))
    marks = kept.select("session_id", "msg_idx", F.lit(1).alias("_opens"))
    held = messages.join(marks, ["session_id", "msg_idx"], "left").withColumn("_span", F.count("_opens").over(own))
    agent = held.where(F.col("kind").isin("reply", "subagent_spawn"))
    shown = (F.coalesce(F.trim("text"), F.lit("")) != "") & ~F.coalesce(F.startswith(F.ltrim("text"), F.lit(MARKER)), F.lit(False))
    at = F.when(shown, F.col("msg_idx"))
    said = agent.groupBy("session_id", "_span").agg(
        F.min_by(F.struct("text", "ts"), at).alias("_first"), F.max_by(F.struct("text", "ts"), at).alias("_last")
    )
    calls = agent.select("session_id", "_span", F.explode("content").alias("b")).where("b.type = 'tool_use'")
    line = F.when(F.element_at(F.split("b.name", ":"), -1).isin(COMMANDS), first_of(F.col("b.input"), COMMAND_KEYS))
    counts = calls.groupBy("session_id", "_span", F.coalesce("b.name", F.lit("")).alias("tool")).agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce(git_verb(line, "commit"), F.lit(False))).alias("c"), F.bool_or(F.coalesce(git_verb(line, "push"), F.lit(False))).alias("p")
    )
    tools = counts.groupBy("session_id", "_span").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "n")))).alias("_tools"), F.sum("n").cast("long").alias("_calls"), F.bool_or("c").alias("_commit"), F.bool_or("p").alias("_push")
    )
    # a session's spans after its last turn have an end too, so both sides come by number
    spans = said.join(tools, ["session_id", "_span"], "full")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    before = spans.select("session_id", (F.col("_span") + 1).alias("_n"), F.col("_last").alias("_report"), F.col("_tools").alias("_tb"), F.col("_calls").alias("_cb"))
    after = spans.select("session_id", F.col("_span").alias("_n"), F.col("_first").alias("_plan"), F.col("_tools").alias("_ta"), F.col("_calls").alias("_ca"), "_commit", "_push")
    names = messages.groupBy("session_id").agg(F.max("harness").alias("harness"), F.max("cwd").alias("cwd"))
    rows = kept.where("_n > 1").join(before, ["session_id", "_n"], "left").join(after, ["session_id", "_n"], "left").join(names, "session_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "harness", F.col("session_id").alias("session"), "cwd", (F.col("_n") - 1).cast("long").alias("index"), F.col("id").alias("prompt_id"), F.col("ts").alias("timestamp"),
        F.col("_report.text").alias("report"), F.col("_report.ts").alias("report_at"), F.col("text").alias("prompt"), "queued", F.lit("adapter").alias("proof"),
        F.startswith(F.ltrim("text"), F.lit("[from ")).alias("relayed"), F.col("_plan.text").alias("plan"), F.col("_plan.ts").alias("plan_at"),
        F.coalesce("_tb", none).alias("tools_before"), F.coalesce("_cb", zero).alias("tool_calls_before"), F.coalesce("_ta", none).alias("tools_after"), F.coalesce("_ca", zero).alias("tool_calls_after"),
        F.coalesce("_commit", F.lit(False)).alias("commit_after"), F.coalesce("_push", F.lit(False)).alias("push_after"),
    )
