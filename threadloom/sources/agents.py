"""Transcripts of agents whose records need more than one line to make a message, and the older single-document rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.sources.documents import block, documents, json_of, listed, null, rows
from threadloom.sources.jsonl import BLOCK, USAGE, codex_item, get, lines, numbered, stem, text_of


def millis(v: Column, path: str) -> Column:
    return F.timestamp_millis(get(v, path, "bigint"))


def folder(file: Column, up: int) -> Column:
    """The name of the folder ``up`` levels above a file."""
    return F.element_at(F.split(file, "/"), -1 - up)


def read_codex_document(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Rollouts of 2025: one document with a session object and its items, or a bare list of items.

    Items are those of today's files without time, model or usage. A document without items gives no rows; one that isn't JSON none either.
    """
    v, m = F.col("v"), F.col("m")
    items = F.coalesce(get(v, "$.items", "array<variant>"), get(v, "$", "array<variant>"))
    held = documents(spark, path).select("file", get(v, "$.session.id").alias("s"), get(v, "$.session.timestamp").alias("began"), F.posexplode(items).alias("n", "m"))
    content, role, kind = codex_item(m, "$.")
    origin = F.when(kind == "prompt", "human").when(kind == "reply", "model").otherwise("harness")
    return rows(held, session_id=F.coalesce("s", stem(F.col("file"))), msg_idx=F.col("n").cast("long"), role=role, kind=kind, origin=origin, ts=F.try_to_timestamp("began"), content=content)


def read_openclaw(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Session files with a header line. Entries of version 3 name their parent; in older, linear ones each hangs on the entry before it.

    Roles beside the model's: a shell run by the person is a prompt that shows the command and its output, summaries of branches and compactions
    are system rows, other custom records notices.
    """
    v = F.col("v")
    role_of, kind_of = get(v, "$.message.role"), get(v, "$.type")
    own = Window.partitionBy("file").orderBy("block", "at")
    held = lines(spark, path)
    head = lambda p: F.first(F.when(kind_of == "session", get(v, p)), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = held.withColumn("s", F.coalesce(head("$.id"), stem(F.col("file")))).withColumn("version", head("$.version").cast("int")).where(kind_of.isin("message", "compaction"))
    held = held.withColumn("before", F.lag(get(v, "$.id")).over(own))

    def part(p: Column) -> Column:
        kind = get(p, "$.type")
        call = block("tool_use", None, get(p, "$.id"), get(p, "$.name"), json_of(p, "$.arguments"))
        return F.when(kind == "toolCall", call).otherwise(block(F.coalesce(kind, F.lit("text")), F.coalesce(get(p, "$.text"), get(p, "$.thinking"))))

    parts = get(v, "$.message.content", "array<variant>")
    said = F.when(parts.isNotNull(), F.transform(parts, part)).otherwise(F.array(block("text", get(v, "$.message.content"))))
    answer = F.array(block("tool_result", text_of(get(v, "$.message.content", "variant")), None, None, None, get(v, "$.message.toolCallId"), get(v, "$.message.isError", "boolean")))
    shell = F.array(block("text", F.concat(F.lit("$ "), F.coalesce(get(v, "$.message.command"), F.lit("")), F.lit("\n"), F.coalesce(get(v, "$.message.output"), F.lit("")))))
    summed = F.array(block("text", F.coalesce(get(v, "$.message.summary"), get(v, "$.summary"))))
    compact = (kind_of == "compaction") | (role_of == "compactionSummary")
    content = F.when(compact | (role_of == "branchSummary"), summed).when(role_of == "toolResult", answer).when(role_of == "bashExecution", shell).otherwise(said)
    kind = (
        F.when(compact, "compaction_summary").when(role_of == "branchSummary", "branch").when(role_of == "toolResult", "tool_result").when(role_of.isin("user", "bashExecution"), "prompt")
        .when(role_of == "assistant", "reply").otherwise("notice")
    )
    role = F.when(kind == "tool_result", "tool").when(kind == "prompt", "user").when(kind == "reply", "assistant").otherwise("system")
    used = "$.message.usage"
    usage = F.struct(get(v, "$.message.responseId"), *[get(v, f"{used}.{n}", "bigint") for n in ("input", "output", "cacheRead", "cacheWrite")]).cast(USAGE)
    parent = F.when(F.coalesce(F.col("version") >= 3, F.lit(False)), get(v, "$.parentId")).otherwise(F.coalesce(get(v, "$.parentId"), F.col("before")))
    return numbered(rows(
        held, session_id=F.col("s"), id=get(v, "$.id"), parent_id=parent, role=role, kind=kind, ts=F.coalesce(F.try_to_timestamp(get(v, "$.timestamp")), millis(v, "$.message.timestamp")),
        model=F.coalesce(get(v, "$.message.responseModel"), get(v, "$.message.model")), content=content, usage=F.when(get(v, used, "variant").isNotNull(), usage),
    ))


def read_grok(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``chat_history.jsonl`` files, each in its session's folder. Reasoning that comes as lines of its own leads the next message of the file.

    User lines that the agent made up (``synthetic_reason``) are injected context. Reasoning after the last message is a notice.
    """
    v = F.col("v")
    kind_of = get(v, "$.type")
    alone = kind_of == "reasoning"
    own = Window.partitionBy("file").orderBy("block", "at")
    held = lines(spark, path).where(kind_of.isin("system", "user", "assistant", "tool_result", "reasoning"))
    # a thought has the number of the message that follows it
    held = held.withColumn("turn", F.count_if(~alone).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    summary = F.array_join(F.filter(F.transform(listed(v, "$.summary"), lambda p: get(p, "$.text")), lambda t: t.isNotNull()), "\n")
    thoughts = F.collect_list(F.when(alone, block("thinking", summary))).over(Window.partitionBy("file", "turn").orderBy("block", "at"))
    held = held.withColumn("thoughts", thoughts).withColumn("last", F.lead("turn").over(own).isNull())
    held = held.where(~alone | F.col("last"))
    inner = F.when(get(v, "$.reasoning.text") != "", F.array(block("thinking", get(v, "$.reasoning.text")))).otherwise(F.array().cast(f"array<{BLOCK}>"))
    said = text_of(get(v, "$.content", "variant"))
    texts = F.when(F.coalesce(said, F.lit("")) != "", F.array(block("text", said))).otherwise(F.array().cast(f"array<{BLOCK}>"))
    calls = F.transform(listed(v, "$.tool_calls"), lambda c: block("tool_use", None, get(c, "$.id"), get(c, "$.name"), F.coalesce(get(c, "$.arguments"), json_of(c, "$.arguments"))))
    answer = F.array(block("tool_result", said, None, None, None, get(v, "$.tool_call_id")))
    content = F.when(kind_of == "tool_result", answer).when(alone, F.col("thoughts")).otherwise(F.concat(F.col("thoughts"), inner, texts, calls))
    injected = (kind_of == "user") & get(v, "$.synthetic_reason").isNotNull()
    kind = F.when(injected, "injected_context").when(kind_of == "user", "prompt").when(kind_of == "assistant", "reply").when(kind_of == "tool_result", "tool_result").when(kind_of == "system", "system_prompt").otherwise("notice")
    role = F.when(kind_of == "tool_result", "tool").when(alone, "system").otherwise(kind_of)
    origin = F.when(kind == "prompt", "human").when(kind == "reply", "model").otherwise("harness")
    return numbered(rows(held, session_id=folder(F.col("file"), 1), role=role, kind=kind, origin=origin, model=get(v, "$.model_id"), content=content))


def read_kimi_code(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``wire.jsonl`` logs, one for each agent of a session; sub-agents are sessions of their own, named by their folder below the session's.

    The parts and calls of a step are one reply, where the step began, with the usage of its end; each result is a row of its own. A step that was cut off
    has no usage. A compaction gives a boundary and its summary.
    """
    v = F.col("v")
    kind_of, event = get(v, "$.type"), get(v, "$.event.type")
    own = Window.partitionBy("file").orderBy("block", "at")
    step = F.count_if(event == "step.begin").over(own)
    agent = folder(F.col("file"), 1)
    session = F.when(agent == "main", folder(F.col("file"), 3)).otherwise(F.concat_ws("/", folder(F.col("file"), 3), agent))
    models = F.last(F.coalesce(F.when(kind_of.isin("profile.bind", "config.update"), get(v, "$.modelAlias"))), ignorenulls=True).over(own)
    held = lines(spark, path).withColumns({"session": session, "step": step, "model": models, "ts": millis(v, "$.time"), "event": event, "kind_of": kind_of})
    base = ["file", "session"]

    def part(p: Column) -> Column:
        think = get(p, "$.type") == "think"
        return block(F.when(think, "thinking").otherwise(F.coalesce(get(p, "$.type"), F.lit("text"))), F.coalesce(get(p, "$.text"), get(p, "$.think")))

    # replies: the blocks of each step in order
    call = block("tool_use", None, get(v, "$.event.toolCallId"), get(v, "$.event.name"), json_of(v, "$.event.args"))
    said = part(get(v, "$.event.part", "variant"))
    piece = F.when(F.col("event") == "tool.call", call).when((F.col("event") == "content.part") & (F.coalesce(said["text"], F.lit("")) != ""), said)
    used = F.struct(get(v, "$.event.messageId"), *[get(v, f"$.event.usage.{n}", "bigint") for n in ("inputOther", "output", "inputCacheRead", "inputCacheCreation")]).cast(USAGE)
    steps = held.where((F.col("kind_of") == "context.append_loop_event") & F.col("event").isin("step.begin", "content.part", "tool.call", "step.end") & (F.col("step") > 0))
    place = F.struct("block", "at")
    replies = steps.groupBy(*base, "step").agg(
        F.min(place).alias("_place"), F.min("ts").alias("ts"), F.max("model").alias("model"), F.max(F.when((F.col("event") == "step.end") & get(v, "$.event.usage", "variant").isNotNull(), used)).alias("usage"),
        F.sort_array(F.collect_list(F.when(piece.isNotNull(), F.struct("block", "at", piece.alias("b"))))).alias("_parts"),
    ).where(F.size("_parts") > 0)
    replies = replies.select(
        "file", "session", F.col("_place.block").alias("block"), F.col("_place.at").alias("at"), F.lit(0).alias("sub"), F.lit("assistant").alias("role"), F.lit("reply").alias("kind"), F.lit("model").alias("origin"), "ts", "model", "usage",
        F.transform("_parts", lambda x: x["b"]).alias("content"),
    )

    def plain(test: Column, sub: int, role, kind, origin, content: Column) -> DataFrame:
        of = lambda x: F.lit(x) if isinstance(x, str) else x
        return held.where(test).select(*base, "block", "at", F.lit(sub).alias("sub"), of(role).alias("role"), of(kind).alias("kind"), of(origin).alias("origin"), "ts", null().alias("model"), null(USAGE).alias("usage"), content.alias("content"))

    result = F.array(block("tool_result", text_of(get(v, "$.event.result.output", "variant")), None, None, None, get(v, "$.event.toolCallId"), get(v, "$.event.result.isError", "boolean")))
    by = get(v, "$.message.origin.kind")
    typed = F.coalesce(by == "user", F.lit(False))
    parts = get(v, "$.message.content", "array<variant>")
    message = F.when(parts.isNotNull(), F.transform(parts, part)).otherwise(F.array(block("text", get(v, "$.message.content"))))
    empty = F.array().cast(f"array<{BLOCK}>")
    compact = F.col("kind_of") == "context.apply_compaction"
    told = (
        replies.unionByName(plain((F.col("kind_of") == "context.append_loop_event") & (F.col("event") == "tool.result"), 0, "tool", "tool_result", "harness", result))
        .unionByName(plain(F.col("kind_of") == "context.append_message", 0, "user", F.when(typed, "prompt").otherwise("injected_context"), F.when(typed, "human").when(by.isin("background_task", "task"), "scheduler").otherwise("harness"), message))
        .unionByName(plain(compact, 0, "system", "compaction_boundary", "harness", empty)).unionByName(plain(compact, 1, "system", "compaction_summary", "harness", F.array(block("text", get(v, "$.summary")))))
        .unionByName(plain(F.col("kind_of").isin("task.terminated", "turn.cancel"), 0, "system", "notice", F.when(F.col("kind_of") == "turn.cancel", "human").otherwise("harness"), F.array(block("text", F.coalesce(get(v, "$.outputTail"), F.lit(""))))))
    )
    at = F.row_number().over(Window.partitionBy("file").orderBy("block", "at", "sub")) - 1
    return told.select(
        F.col("session").alias("session_id"), at.cast("long").alias("msg_idx"), null().alias("id"), null().alias("parent_id"), "role", "kind", "origin", "ts", "model", "content", "usage"
    )
