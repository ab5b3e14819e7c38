"""Agents that keep their sessions in SQLite, as messages with typed blocks (MESSAGE_COLUMNS).

Every reader takes the paths of stores. JSON cells are parsed as variants, so a cell that is no
JSON gives a message without blocks and never fails a session. Sessions are separate by their ids alone; copies of a
store are told apart by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.graphs import depths, ways_up
from threadloom.session import written
from threadloom.sources.documents import block, json_of, listed, null, openai_calls, rows, usage_of
from threadloom.sources.jsonl import BLOCK, MESSAGE_COLUMNS, USAGE, get, text_of
from threadloom.sources.sqlite import read_table

#: seconds beyond which an epoch is in milliseconds
MILLIS_FROM = 10_000_000_000


def epoch(column: Column) -> Column:
    """A time in seconds or milliseconds of the epoch."""
    value = column.try_cast("double")
    return F.timestamp_micros((F.when(value >= MILLIS_FROM, value * 1000).otherwise(value * 1_000_000)).cast("long"))


def no_blocks() -> Column:
    return F.array().cast(f"array<{BLOCK}>")


def in_order(held: DataFrame, *order: Column | str) -> Column:
    return (F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1).cast("long")


def read_opencode(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Messages with their parts, which a table of their own holds; a tool's part is its call and its result."""
    told = read_table(spark, paths, "message", "id string, session_id string, time_created long, data string")
    part = read_table(spark, paths, "part", "id string, message_id string, data string").select("id", F.col("message_id").alias("m"), F.try_parse_json("data").alias("p"))
    p = F.col("p")
    kind = get(p, "$.type")
    use = block("tool_use", None, get(p, "$.callID"), get(p, "$.tool"), json_of(p, "$.state.input"))
    ended = get(p, "$.state.status").isin("completed", "error")
    answer = block("tool_result", F.coalesce(get(p, "$.state.output"), get(p, "$.state.error")), None, None, None, get(p, "$.callID"), get(p, "$.state.status") == "error")
    made = (
        F.when(kind == "text", F.array(block("text", get(p, "$.text")))).when(kind == "reasoning", F.array(block("thinking", get(p, "$.text"))))
        .when((kind == "tool") & ended, F.array(use, answer)).when(kind == "tool", F.array(use)).when(kind == "file", F.array(block("file", get(p, "$.filename"), None, get(p, "$.mime"), get(p, "$.url"))))
        .otherwise(no_blocks())
    )
    marks = F.struct("id", made.alias("blocks"), (kind == "compaction").alias("compaction"), kind.isin("agent", "subtask").alias("spawn"))
    parts = part.groupBy("m").agg(F.array_sort(F.collect_list(marks)).alias("parts"))
    held = told.join(parts, F.col("id") == F.col("m"), "left").select("session_id", "id", "time_created", F.try_parse_json("data").alias("v"), F.coalesce("parts", F.array()).alias("parts"))
    v, role = F.col("v"), get(F.col("v"), "$.role")
    what = (
        F.when(get(v, "$.error", "variant").isNotNull(), "error").when(get(v, "$.summary", "boolean") & (role == "assistant"), "compaction_summary")
        .when(F.exists("parts", lambda x: x["compaction"]), "compaction_boundary").when(F.exists("parts", lambda x: x["spawn"]), "subagent_spawn")
        .when(role == "user", "prompt").when(role == "assistant", "reply").otherwise("notice")
    )
    origin = F.when(what.isin("error", "compaction_summary", "compaction_boundary"), "harness").when(role == "user", "human").when(role == "assistant", "model").otherwise("harness")
    tokens = F.struct(null(), get(v, "$.tokens.input", "bigint"), get(v, "$.tokens.output", "bigint"), get(v, "$.tokens.cache.read", "bigint"), get(v, "$.tokens.cache.write", "bigint")).cast(USAGE)
    return rows(
        held, session_id=F.col("session_id"), msg_idx=in_order(held, "time_created", "id"), id=F.col("id"), parent_id=get(v, "$.parentID"), role=role, kind=what, origin=origin, ts=epoch(F.col("time_created")),
        model=F.coalesce(get(v, "$.modelID"), get(v, "$.model.modelID")), content=F.flatten(F.transform("parts", lambda x: x["blocks"])), usage=F.when(get(v, "$.tokens", "variant").isNotNull(), tokens),
    )


def read_goose(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Message rows whose content is a list of blocks; rows of tool responses alone are a tool's, hidden ones the harness's."""
    held = read_table(spark, paths, "messages", "id long, message_id string, session_id string, role string, content_json string, created_timestamp long, metadata_json string")
    held = held.withColumn("v", F.try_parse_json("content_json")).withColumn("meta", F.try_parse_json("metadata_json"))

    def one(b: Column) -> Column:
        kind, value = get(b, "$.type"), get(b, "$.toolResult.value", "variant")
        said = text_of(F.coalesce(get(value, "$.content", "variant"), value))
        bad = F.coalesce(get(value, "$.isError", "boolean"), F.lit(False)) | (get(b, "$.toolResult.status") == "error")
        call = kind.isin("toolRequest", "frontendToolRequest")
        return (
            F.when(call, block("tool_use", None, get(b, "$.id"), get(b, "$.toolCall.value.name"), json_of(b, "$.toolCall.value.arguments")))
            .when(kind == "toolResponse", block("tool_result", F.coalesce(said, get(b, "$.toolResult.error")), None, None, None, get(b, "$.id"), bad))
            .when(kind == "thinking", block("thinking", get(b, "$.thinking"))).when(kind == "image", block("image", None, None, get(b, "$.mimeType"))).when(kind == "error", block("error", get(b, "$.message")))
            .otherwise(block(F.coalesce(kind, F.lit("text")), F.coalesce(get(b, "$.text"), get(b, "$.msg"))))
        )

    content = F.transform(listed(F.col("v"), "$"), one)
    answers = (F.size(content) > 0) & F.forall(content, lambda b: b["type"] == "tool_result")
    hidden = get(F.col("meta"), "$.userVisible", "boolean") == F.lit(False)
    role = F.when(answers, "tool").when(hidden, "system").otherwise(F.col("role"))
    kind = F.when(F.exists(content, lambda b: b["type"] == "error"), "error").when(answers, "tool_result").when(hidden, "injected_context").when(F.col("role") == "user", "prompt").otherwise("reply")
    m = F.col("meta")
    used = F.struct(null(), get(m, "$.usage.inputTokens", "bigint"), get(m, "$.usage.outputTokens", "bigint"), get(m, "$.usage.cacheReadTokens", "bigint"), get(m, "$.usage.cacheWriteTokens", "bigint")).cast(USAGE)
    return rows(
        held, session_id=F.col("session_id"), msg_idx=in_order(held, "created_timestamp", "id"), id=F.coalesce("message_id", F.col("id").cast("string")), role=role, kind=kind, ts=epoch(F.col("created_timestamp")),
        model=F.coalesce(get(m, "$.inference.resolvedModel"), get(m, "$.inference.requestedModel")), content=content, usage=F.when(get(m, "$.usage", "variant").isNotNull(), used),
    )


HERMES_JSON = "\x00json:"


def read_hermes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Message rows in the openai shape, as shown: rows neither active nor compacted are rewound ones and left out."""
    schema = "id long, session_id string, role string, content string, tool_calls string, tool_call_id string, tool_name string, timestamp double, reasoning string, reasoning_content string, active long, compacted long, _compressed_summary long"
    held = read_table(spark, paths, "messages", schema).where("coalesce(active, 1) = 1 OR coalesce(compacted, 0) = 1").withColumn("calls", F.try_parse_json("tool_calls"))
    coded = F.startswith("content", F.lit(HERMES_JSON))
    text = F.when(coded, text_of(F.try_parse_json(F.substr("content", F.lit(len(HERMES_JSON) + 1))))).otherwise(F.col("content"))
    thought = F.concat_ws("\n", "reasoning", "reasoning_content")
    said = F.when(F.col("role") == "tool", F.array(block("tool_result", text, None, None, None, F.col("tool_call_id")))).when(F.coalesce(text, F.lit("")) != "", F.array(block("text", text))).otherwise(no_blocks())
    content = F.concat(F.when(thought != "", F.array(block("thinking", thought))).otherwise(no_blocks()), said, openai_calls(F.col("calls"), "$"))
    kind = F.when(F.col("_compressed_summary") == 1, "compaction_summary").when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "reply").when(F.col("role") == "tool", "tool_result").otherwise("notice")
    return rows(held, session_id=F.col("session_id"), msg_idx=in_order(held, "id"), id=F.col("id").cast("string"), role=F.col("role"), kind=kind, ts=epoch(F.col("timestamp")), content=content)


def read_zed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Threads, each one JSON document, compressed or not; the older list of segments and the newer tagged messages."""
    held = read_table(spark, paths, "threads", "id string, data string, parent_id string", zstd="data", rows="500").withColumn("v", F.try_parse_json("data"))
    each = held.select(F.col("id").alias("session_id"), get(F.col("v"), "$.model.model").alias("model"), F.posexplode(listed(F.col("v"), "$.messages")).alias("n", "m"))
    m = F.col("m")

    def result(r: Column) -> Column:
        said = F.coalesce(get(r, "$.content.Text"), text_of(get(r, "$.content", "variant")), json_of(r, "$.output"))
        return block("tool_result", said, None, None, None, get(r, "$.tool_use_id"), get(r, "$.is_error", "boolean"))

    def segment(s: Column) -> Column:
        return block(F.when(get(s, "$.type") == "thinking", "thinking").otherwise("text"), F.coalesce(get(s, "$.text"), get(s, "$.thinking")))

    def tagged(c: Column) -> Column:
        call = get(c, "$.ToolUse", "variant").isNotNull()
        return (
            F.when(call, block("tool_use", None, get(c, "$.ToolUse.id"), get(c, "$.ToolUse.name"), json_of(c, "$.ToolUse.input"))).when(get(c, "$.Thinking", "variant").isNotNull(), block("thinking", get(c, "$.Thinking.text")))
            .when(get(c, "$.Mention", "variant").isNotNull(), block("file", json_of(c, "$.Mention.uri"))).otherwise(block("text", get(c, "$.Text")))
        )

    answers = F.transform(F.map_values(F.coalesce(get(m, "$.Agent.tool_results", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), result)
    calls = F.transform(listed(m, "$.tool_uses"), lambda c: block("tool_use", None, get(c, "$.id"), get(c, "$.name"), json_of(c, "$.input")))
    plain = F.when(get(m, "$.segments", "variant").isNotNull(), F.transform(listed(m, "$.segments"), segment)).otherwise(F.array(block("text", get(m, "$.text"))))
    old = get(m, "$.role")
    user, agent = get(m, "$.User", "variant").isNotNull(), get(m, "$.Agent", "variant").isNotNull()
    content = (
        F.when(user, F.transform(listed(m, "$.User.content"), tagged)).when(agent, F.concat(F.transform(listed(m, "$.Agent.content"), tagged), answers))
        .when(old.isNotNull(), F.concat(plain, calls, F.transform(listed(m, "$.tool_results"), result))).otherwise(no_blocks())
    )
    role = F.coalesce(old, F.when(user, "user").when(agent, "assistant").otherwise("system"))
    kind = F.when(get(m, "$.Compaction", "variant").isNotNull(), "compaction_boundary").when(role == "user", "prompt").when(role == "assistant", "reply").otherwise("notice")
    return rows(each, session_id=F.col("session_id"), msg_idx=F.col("n").cast("long"), id=F.coalesce(get(m, "$.User.id"), get(m, "$.id")), role=role, kind=kind, model=F.col("model"), content=content)


def read_cursor(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Threads and bubbles of the key-value store; a thread's order is its list of bubbles, or what it holds itself in older ones."""
    cells = read_table(spark, paths, "cursorDiskKV", "key string, value string")
    threads = cells.where(F.startswith("key", F.lit("composerData:"))).select(F.substr("key", F.lit(14)).alias("session_id"), F.try_parse_json("value").alias("v"))
    named = F.split(F.col("key"), ":")
    bubbles = cells.where(F.startswith("key", F.lit("bubbleId:"))).select(F.get(named, F.lit(1)).alias("session_id"), F.get(named, F.lit(2)).alias("bubble"), F.try_parse_json("value").alias("m"))
    headers = threads.select("session_id", F.posexplode(listed(F.col("v"), "$.fullConversationHeadersOnly")).alias("n", "h"))
    pointed = headers.select("session_id", "n", get(F.col("h"), "$.bubbleId").alias("bubble")).join(bubbles, ["session_id", "bubble"])
    inline = threads.select("session_id", F.posexplode(listed(F.col("v"), "$.conversation")).alias("n", "m")).select("session_id", "n", get(F.col("m"), "$.bubbleId").alias("bubble"), "m")
    held = pointed.unionByName(inline)
    m = F.col("m")
    role = F.when(get(m, "$.type", "int") == 1, "user").otherwise("assistant")
    tool = "$.toolFormerData."
    use = F.coalesce(get(m, tool + "toolCallId"), F.col("bubble"))
    call = F.array(block("tool_use", None, use, get(m, tool + "name"), F.coalesce(get(m, tool + "rawArgs"), get(m, tool + "params"))))
    answer = F.when(get(m, tool + "result", "variant").isNotNull(), F.array(block("tool_result", get(m, tool + "result"), None, None, None, use, get(m, tool + "status") == "error"))).otherwise(no_blocks())
    some = lambda kind, path: F.when(F.coalesce(get(m, path), F.lit("")) != "", F.array(block(kind, get(m, path)))).otherwise(no_blocks())
    content = F.concat(some("thinking", "$.thinking.text"), some("text", "$.text"), F.when(get(m, tool + "name").isNotNull(), F.concat(call, answer)).otherwise(no_blocks()))
    return rows(held, session_id=F.col("session_id"), msg_idx=in_order(held, "n"), id=F.col("bubble"), role=role, content=content, usage=usage_of(m, "$.tokenCount", "inputTokens", "outputTokens"))


def read_devin(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The main chain of each session's forest, and a session ``id/agent`` for each sub-agent's chain.

    A context that was rebuilt is a new chain with copies of older nodes, so a transcript is the way from its head up to a root; all
    ways are walked together in doubled steps. A session without a named head ends in its newest node; a head that isn't there has no messages.
    """
    nodes = read_table(spark, paths, "message_nodes", "session_id string, node_id long, parent_node_id long, chat_message string, created_at long")
    nodes = written(nodes, "nodes")  # the walk reads it several times
    sessions = read_table(spark, paths, "sessions", "id string, main_chain_id long").select(F.col("id").alias("session_id"), "main_chain_id")
    newest = nodes.groupBy("session_id").agg(F.max("node_id").alias("newest"))
    main = newest.join(sessions, "session_id", "left").select("session_id", F.col("session_id").alias("told"), F.coalesce("main_chain_id", "newest").alias("node_id"))
    agents = read_table(spark, paths, "subagent_heads", "session_id string, agent_id string, chain_node_id long").select("session_id", F.concat_ws("/", "session_id", "agent_id").alias("told"), F.col("chain_node_id").alias("node_id"))
    heads = main.unionByName(agents).join(nodes.select("session_id", "node_id"), ["session_id", "node_id"])
    key = lambda c: F.struct("session_id", F.col(c).alias("node_id"))
    links = nodes.where("parent_node_id IS NOT NULL").select(key("node_id").alias("id"), key("parent_node_id").alias("up"))
    walked = ways_up(links, heads.select(key("node_id").alias("id")).distinct())
    deep = depths(nodes.select(key("node_id").alias("id"), F.when(F.col("parent_node_id").isNotNull(), key("parent_node_id")).alias("parent_id"))).select("id", "depth")
    chain = heads.select("told", key("node_id").alias("start")).join(walked, "start").join(deep, "id").select(F.col("told"), F.col("id.session_id").alias("session_id"), F.col("id.node_id").alias("node_id"), "depth")
    held = chain.join(nodes, ["session_id", "node_id"]).select(F.col("told").alias("session_id"), "depth", "node_id", "created_at", F.try_parse_json("chat_message").alias("v"))
    v = F.col("v")
    role = get(v, "$.role")
    text = get(v, "$.content")
    said = F.when(role == "tool", F.array(block("tool_result", text, None, None, None, get(v, "$.tool_call_id")))).when(F.coalesce(text, F.lit("")) != "", F.array(block("text", text))).otherwise(no_blocks())
    thought = get(v, "$.thinking.thinking")
    calls = F.transform(listed(v, "$.tool_calls"), lambda c: block("tool_use", None, get(c, "$.id"), get(c, "$.name"), json_of(c, "$.arguments")))
    content = F.concat(F.when(thought != "", F.array(block("thinking", thought))).otherwise(no_blocks()), said, calls)
    tokens = F.struct(null(), *[get(v, f"$.metadata.metrics.{n}", "bigint") for n in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]).cast(USAGE)
    return rows(
        held, session_id=F.col("session_id"), msg_idx=in_order(held, "depth"), id=get(v, "$.message_id"), role=role, ts=epoch(F.col("created_at")), model=get(v, "$.metadata.generation_model"), content=content,
        usage=F.when(get(v, "$.metadata.metrics", "variant").isNotNull(), tokens),
    ).select(*MESSAGE_COLUMNS)
