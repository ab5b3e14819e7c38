"""Transcripts of more agents and chat applications, as messages with typed blocks (MESSAGE_COLUMNS).

Line files go through ``jsonl.lines``, whole JSON documents through ``documents``; what holds no
JSON object or array gives no rows. Tool calls and results become blocks with their ids, so
``jsonl.tool_events`` serves all sources alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.jsonl import BLOCK, MESSAGE_COLUMNS, USAGE, blocks, get, lines, numbered, stem, text_of


def documents(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, v): each whole file's parsed JSON; rows (file, value) may stand in place of a path."""
    whole = path if isinstance(path, DataFrame) else spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    files = whole.select("file", F.try_parse_json("value").alias("v"))
    return files.where("v IS NOT NULL")


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def block(kind: str | Column, text: Column | None = None, id_: Column | None = None, name: Column | None = None, input_: Column | None = None, use: Column | None = None, failed: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    given = [x if x is not None else null() for x in (text, id_, name, input_, use)]
    return F.struct(kind, *given, failed if failed is not None else null("boolean")).cast(BLOCK)


def json_of(v: Column, path: str) -> Column:
    return F.to_json(get(v, path, "variant"))


def listed(v: Column, path: str) -> Column:
    return F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def usage_of(v: Column, base: str, input_: str, output: str, cached: str | None = None, response: str | None = None) -> Column:
    """Usage with cached input taken out of the input, or null where there is none."""
    held = F.coalesce(get(v, f"{base}.{cached}", "bigint"), F.lit(0).cast("bigint")) if cached else F.lit(0).cast("bigint")
    own = F.struct(get(v, response) if response else null(), get(v, f"{base}.{input_}", "bigint") - held, get(v, f"{base}.{output}", "bigint"), held, null("bigint"))
    return F.when(get(v, base, "variant").isNotNull(), own.cast(USAGE))


def rows(frame: DataFrame, **given: Column) -> DataFrame:
    """MESSAGE_COLUMNS from the expressions given; kind and origin follow the role unless given."""
    role = given["role"]
    kind = F.when(role == "user", "prompt").when(role == "assistant", "reply").when(role == "tool", "tool_result").otherwise("notice")
    origin = F.when(role == "user", "human").when(role == "assistant", "model").otherwise("harness")
    whole = {"kind": kind, "origin": origin, "id": null(), "parent_id": null(), "ts": null("timestamp"), "model": null(), "usage": null(USAGE)} | given
    return frame.select(*[c for c in ("file", "block", "at") if c in frame.columns and "msg_idx" not in given], *[whole[c].alias(c) for c in MESSAGE_COLUMNS if c in whole])


def google_parts(parts: Column) -> Column:
    """Blocks of a list of parts in the gemini shape."""

    def one(p: Column) -> Column:
        call, answer = get(p, "$.functionCall", "variant"), get(p, "$.functionResponse", "variant")
        return (
            F.when(call.isNotNull(), block("tool_use", None, get(p, "$.functionCall.id"), get(p, "$.functionCall.name"), json_of(p, "$.functionCall.args")))
            .when(answer.isNotNull(), block("tool_result", json_of(p, "$.functionResponse.response"), None, None, None, get(p, "$.functionResponse.id")))
            .when(get(p, "$.thought", "boolean"), block("thinking", get(p, "$.text"))).otherwise(block("text", F.coalesce(get(p, "$.text"), get(p, "$"))))
        )

    return F.transform(parts, one)


def read_gemini(spark: SparkSession, path: str) -> DataFrame:
    """Chat recordings as one document: user and model messages, a message's calls with their results, tokens and thoughts."""
    held = documents(spark, path).select("file", get(F.col("v"), "$.sessionId").alias("s"), F.posexplode(listed(F.col("v"), "$.messages")).alias("n", "m"))
    m = F.col("m")
    role = F.when(get(m, "$.type") == "user", "user").when(get(m, "$.type") == "gemini", "assistant").otherwise("system")
    said = F.when(get(m, "$.content", "array<variant>").isNotNull(), google_parts(listed(m, "$.content"))).otherwise(F.array(block("text", get(m, "$.content"))))
    thoughts = F.transform(listed(m, "$.thoughts"), lambda t: block("thinking", F.concat_ws(": ", get(t, "$.subject"), get(t, "$.description"))))
    calls = F.transform(listed(m, "$.toolCalls"), lambda c: block("tool_use", None, get(c, "$.id"), get(c, "$.name"), json_of(c, "$.args")))
    answers = F.transform(F.filter(listed(m, "$.toolCalls"), lambda c: get(c, "$.result", "variant").isNotNull()), lambda c: block("tool_result", json_of(c, "$.result"), None, None, None, get(c, "$.id"), get(c, "$.status") == "error"))
    return rows(
        held, session_id=F.coalesce(F.col("s"), stem(F.col("file"))), msg_idx=F.col("n").cast("long"), id=get(m, "$.id"), role=role, ts=F.try_to_timestamp(get(m, "$.timestamp")),
        model=get(m, "$.model"), content=F.concat(thoughts, said, calls, answers), usage=usage_of(m, "$.tokens", "input", "output", "cached"),
    )


def read_qwen(spark: SparkSession, path: str) -> DataFrame:
    """Session lines whose messages hold parts in the gemini shape, threaded by parent ids."""
    v = F.col("v")
    role = F.when(get(v, "$.type") == "tool_result", "tool").otherwise(get(v, "$.type"))
    held = lines(spark, path).where(get(v, "$.type").isin("user", "assistant", "tool_result", "system"))
    return numbered(rows(
        held, session_id=F.coalesce(get(v, "$.sessionId"), stem(F.col("file"))), id=get(v, "$.uuid"), parent_id=get(v, "$.parentUuid"), role=role, ts=F.try_to_timestamp(get(v, "$.timestamp")),
        model=get(v, "$.model"), content=google_parts(listed(v, "$.message.parts")), usage=usage_of(v, "$.usageMetadata", "promptTokenCount", "candidatesTokenCount", "cachedContentTokenCount"),
    ))


def read_pi(spark: SparkSession, path: str) -> DataFrame:
    """Tree files: the first line names the session; messages and compactions are threaded by parent ids."""
    from pyspark.sql import Window

    v = F.col("v")
    kind_of = get(v, "$.type")
    held = lines(spark, path)
    named = F.first(F.when(kind_of == "session", get(v, "$.id")), ignorenulls=True).over(Window.partitionBy("file"))
    held = held.withColumn("s", F.coalesce(named, stem(F.col("file")))).where(kind_of.isin("message", "compaction"))
    result = get(v, "$.message.role") == "toolResult"

    def part(p: Column) -> Column:
        call = get(p, "$.type") == "toolCall"
        return F.when(call, block("tool_use", None, get(p, "$.id"), get(p, "$.name"), json_of(p, "$.arguments"))).otherwise(block(F.coalesce(get(p, "$.type"), F.lit("text")), F.coalesce(get(p, "$.text"), get(p, "$.thinking"))))

    listed_ = get(v, "$.message.content", "array<variant>")
    said = F.when(listed_.isNotNull(), F.transform(listed_, part)).otherwise(F.array(block("text", get(v, "$.message.content"))))
    answer = F.array(block("tool_result", text_of(get(v, "$.message.content", "variant")), None, None, None, get(v, "$.message.toolCallId"), get(v, "$.message.isError", "boolean")))
    content = F.when(kind_of == "compaction", F.array(block("text", get(v, "$.summary")))).when(result, answer).otherwise(said)
    role = F.when(kind_of == "compaction", "system").when(result, "tool").otherwise(get(v, "$.message.role"))
    kind = F.when(kind_of == "compaction", "compaction_summary").when(result, "tool_result").when(role == "user", "prompt").when(role == "assistant", "reply").otherwise("notice")
    return numbered(rows(
        held, session_id=F.col("s"), id=get(v, "$.id"), parent_id=get(v, "$.parentId"), role=role, kind=kind, ts=F.try_to_timestamp(get(v, "$.timestamp")), model=get(v, "$.message.model"),
        content=content, usage=usage_of(v, "$.message.usage", "input", "output"),
    ))


def openai_calls(m: Column, path: str) -> Column:
    return F.transform(listed(m, path), lambda c: block("tool_use", None, get(c, "$.id"), get(c, "$.function.name"), get(c, "$.function.arguments")))


def read_continue(spark: SparkSession, path: str) -> DataFrame:
    """Session documents whose history items hold messages in the openai shape."""
    held = documents(spark, path).select("file", get(F.col("v"), "$.sessionId").alias("s"), F.posexplode(listed(F.col("v"), "$.history")).alias("n", "i"))
    m = F.col("i")
    role = get(m, "$.message.role")
    text = text_of(get(m, "$.message.content", "variant"))
    said = F.when(role == "tool", F.array(block("tool_result", text, None, None, None, get(m, "$.message.toolCallId")))).otherwise(F.array(block("text", text)))
    done = F.transform(listed(m, "$.toolCallStates"), lambda c: block("tool_result", text_of(get(c, "$.output", "variant")), None, None, None, get(c, "$.toolCallId"), get(c, "$.status") == "errored"))
    return rows(
        held, session_id=F.coalesce(F.col("s"), stem(F.col("file"))), msg_idx=F.col("n").cast("long"), role=role, content=F.concat(said, openai_calls(m, "$.message.toolCalls"), done),
        model=get(m, "$.message.usage.model"), usage=usage_of(m, "$.message.usage", "prompt_tokens", "completion_tokens"),
    )


def read_lmstudio(spark: SparkSession, path: str) -> DataFrame:
    """Conversation documents; of a turn's versions the selected one, of its steps the content blocks."""
    held = documents(spark, path).select("file", F.posexplode(listed(F.col("v"), "$.messages")).alias("n", "m"))
    versions = listed(F.col("m"), "$.versions")
    chosen = F.coalesce(F.get(versions, get(F.col("m"), "$.currentlySelected", "int")), F.get(versions, F.size(versions) - 1))
    held = held.withColumn("w", chosen).where("w IS NOT NULL")
    w = F.col("w")
    steps = F.filter(listed(w, "$.steps"), lambda s: get(s, "$.type") == "contentBlock")
    from_steps = F.transform(steps, lambda s: block(F.when(get(s, "$.style.type") == "thinking", "thinking").otherwise("text"), text_of(get(s, "$.content", "variant"))))
    content = F.when(get(w, "$.type") == "multiStep", from_steps).otherwise(F.array(block("text", text_of(get(w, "$.content", "variant")))))
    step = F.get(steps, F.size(steps) - 1)
    usage = usage_of(step, "$.genInfo.stats", "promptTokensCount", "predictedTokensCount")
    return rows(
        held, session_id=F.regexp_replace(stem(F.col("file")), r"\.conversation$", ""), msg_idx=F.col("n").cast("long"), role=get(w, "$.role"), content=content,
        model=F.coalesce(get(step, "$.genInfo.indexedModelIdentifier"), get(step, "$.genInfo.identifier")), usage=usage,
    )


def read_cline(spark: SparkSession, path: str) -> DataFrame:
    """Task histories, an array of messages in the anthropic shape a file; the task is the folder's name."""
    held = documents(spark, path).select("file", F.posexplode(listed(F.col("v"), "$")).alias("n", "m"))
    content = blocks(get(F.col("m"), "$.content", "variant"))
    answered = F.exists(content, lambda b: b["type"] == "tool_result")
    role = F.when((get(F.col("m"), "$.role") == "user") & answered, "tool").otherwise(get(F.col("m"), "$.role"))
    return rows(held, session_id=F.regexp_extract("file", r"([^/]+)/[^/]+$", 1), msg_idx=F.col("n").cast("long"), role=role, content=content)


def read_kimi(spark: SparkSession, path: str) -> DataFrame:
    """Context files: roles with a leading underscore are the harness's own; the session is the folder's name, or the file's."""
    v = F.col("v")
    own = F.startswith(get(v, "$.role"), F.lit("_"))
    session = F.when(stem(F.col("file")).rlike("^context(_[0-9]+)?$"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).otherwise(stem(F.col("file")))
    text = text_of(get(v, "$.content", "variant"))
    role = F.when(own, "system").otherwise(get(v, "$.role"))
    said = F.when(role == "tool", F.array(block("tool_result", text, None, None, None, get(v, "$.tool_call_id")))).when(text.isNotNull(), F.array(block("text", text))).otherwise(F.array().cast(f"array<{BLOCK}>"))
    kind = F.when(get(v, "$.role") == "_system_prompt", "system_prompt").when(own, "notice").when(role == "user", "prompt").when(role == "assistant", "reply").when(role == "tool", "tool_result").otherwise("notice")
    held = lines(spark, path).where(get(v, "$.role").isNotNull())
    return numbered(rows(held, session_id=session, role=role, kind=kind, content=F.concat(said, openai_calls(v, "$.tool_calls"))))


def read_claude_export(spark: SparkSession, path: str) -> DataFrame:
    """Account exports: an array of conversations, each with its messages in a line."""
    talks = documents(spark, path).select(F.explode(listed(F.col("v"), "$")).alias("c"))
    held = talks.select(get(F.col("c"), "$.uuid").alias("s"), F.posexplode(listed(F.col("c"), "$.chat_messages")).alias("n", "m"))
    m = F.col("m")
    role = F.when(get(m, "$.sender") == "human", "user").otherwise("assistant")
    content = F.when(F.size(listed(m, "$.content")) > 0, blocks(get(m, "$.content", "variant"))).otherwise(F.array(block("text", get(m, "$.text"))))
    return rows(
        held, session_id=F.col("s"), msg_idx=F.col("n").cast("long"), id=get(m, "$.uuid"), parent_id=get(m, "$.parent_message_uuid"), role=role, ts=F.try_to_timestamp(get(m, "$.created_at")), content=content
    )


def read_chatgpt_export(spark: SparkSession, path: str) -> DataFrame:
    """Account exports: an array of conversations, each a graph of nodes; the messages on the way from the current node to the root, in time.

    A conversation is one row here, so its way is walked inside the row and no join is needed.
    """
    talks = documents(spark, path).select(F.explode(listed(F.col("v"), "$")).alias("c"))
    nodes = get(F.col("c"), "$.mapping", "map<string,variant>")
    held = talks.select(
        F.coalesce(get(F.col("c"), "$.conversation_id"), get(F.col("c"), "$.id")).alias("s"), get(F.col("c"), "$.default_model_slug").alias("slug"),
        get(F.col("c"), "$.current_node").alias("leaf"), nodes.alias("nodes"),
    )
    start = F.struct(F.col("leaf").alias("at"), F.array().cast("array<string>").alias("way"))

    def up(state: Column, _: Column) -> Column:
        here = F.when(~F.array_contains(state["way"], state["at"]), F.element_at("nodes", state["at"]))
        return F.struct(get(here, "$.parent").alias("at"), F.when(here.isNotNull(), F.concat(F.array(state["at"]), state["way"])).otherwise(state["way"]).alias("way"))

    way = F.aggregate(F.map_keys("nodes"), start, up)["way"]
    turns = held.select("s", "slug", F.posexplode(F.filter(F.transform(way, lambda i: F.element_at("nodes", i)), lambda n: get(n, "$.message", "variant").isNotNull())).alias("n", "node"))
    m = F.col("node")
    parts = F.filter(F.transform(listed(m, "$.message.content.parts"), lambda p: get(p, "$")), lambda p: p.isNotNull())
    text = F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(get(m, "$.message.content.text"))
    to = get(m, "$.message.recipient")
    content = F.when(to.isNotNull() & (to != "all"), F.array(block("tool_use", None, get(m, "$.message.id"), to, text))).otherwise(F.array(block("text", text)))
    seconds = get(m, "$.message.create_time", "double")
    return rows(
        turns, session_id=F.col("s"), msg_idx=F.col("n").cast("long"), id=get(m, "$.id"), parent_id=get(m, "$.parent"), role=get(m, "$.message.author.role"), ts=F.timestamp_micros((seconds * 1_000_000).cast("long")),
        model=F.coalesce(get(m, "$.message.metadata.model_slug"), F.col("slug")), content=content,
    )
