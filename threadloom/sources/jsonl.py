"""Transcript files, one JSON record a line, as messages with typed blocks.

Every reader gives MESSAGE_COLUMNS. Lines that hold no JSON object are left out of the
messages and listed by ``bad_lines``; good lines of the same file stay. A record's place is
its block's offset in the file and its order within the block, so large files may be split.
Compressed files (by extension) are read as Spark's text source reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGE_COLUMNS = ["session_id", "msg_idx", "id", "parent_id", "role", "kind", "origin", "ts", "model", "content", "usage"]
BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean>"
USAGE = "struct<response_id:string,input:bigint,output:bigint,cache_read:bigint,cache_creation:bigint>"


def lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, block, at, value, v): each line, where it stands and its parsed value (null if it isn't a JSON object).

    In place of a path, lines that are rows already (file, block, at, value) may be given.
    """
    raw = path if isinstance(path, DataFrame) else spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    v = F.try_parse_json("value")
    return raw.where(F.trim("value") != "").withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).where("v IS NULL").select("file", "value")


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(v: Column) -> Column:
    """A content value as text: a string itself, or the text parts of a list of parts."""
    parts = get(v, "$", "array<variant>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), lambda s: s.isNotNull()), "\n")
    return F.when(parts.isNotNull(), joined).otherwise(get(v, "$"))


def blocks(content: Column) -> Column:
    """Blocks of a message content in the anthropic shape: a string or a list of typed parts."""

    def block(p: Column) -> Column:
        return F.struct(
            F.coalesce(get(p, "$.type"), F.lit("text")).alias("type"),
            F.coalesce(get(p, "$.text"), get(p, "$.thinking"), F.when(get(p, "$.type") == "tool_result", text_of(get(p, "$.content", "variant")))).alias("text"),
            get(p, "$.id").alias("id"), get(p, "$.name").alias("name"), F.to_json(get(p, "$.input", "variant")).alias("input"),
            get(p, "$.tool_use_id").alias("tool_use_id"), get(p, "$.is_error", "boolean").alias("is_error"),
        ).cast(BLOCK)

    nothing = F.lit(None).cast("string")
    plain = F.struct(F.lit("text").alias("type"), get(content, "$").alias("text"), nothing.alias("id"), nothing.alias("name"), nothing.alias("input"), nothing.alias("tool_use_id"), F.lit(None).cast("boolean").alias("is_error"))
    parts = get(content, "$", "array<variant>")
    one = F.when(get(content, "$").isNotNull(), F.array(plain.cast(BLOCK)))
    return F.coalesce(F.when(parts.isNotNull(), F.transform(parts, block)), one, F.array().cast(f"array<{BLOCK}>"))


def numbered(rows: DataFrame) -> DataFrame:
    """``msg_idx`` by place within each session's file."""
    at = F.row_number().over(Window.partitionBy("file", "session_id").orderBy("block", "at")) - 1
    return rows.withColumn("msg_idx", at.cast("long")).select(*MESSAGE_COLUMNS)


def stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(?:\.jsonl?)?(?:\.zst|\.gz)?$", 1)


def read_claude(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("v")
    kind_of = get(v, "$.type")
    content = blocks(get(v, "$.message.content", "variant"))
    results = F.exists(F.col("content"), lambda b: b["type"] == "tool_result")
    kind = (
        F.when(get(v, "$.isCompactSummary", "boolean"), "compaction_summary")
        .when((kind_of == "user") & results, "tool_result").when(kind_of == "user", "prompt").when(kind_of == "assistant", "reply")
        .when(get(v, "$.subtype") == "compact_boundary", "compaction_boundary").otherwise("notice")
    )
    tokens = "$.message.usage."
    usage = F.struct(
        get(v, "$.message.id").alias("response_id"), get(v, tokens + "input_tokens", "bigint").alias("input"), get(v, tokens + "output_tokens", "bigint").alias("output"),
        get(v, tokens + "cache_read_input_tokens", "bigint").alias("cache_read"), get(v, tokens + "cache_creation_input_tokens", "bigint").alias("cache_creation"),
    )
    rows = lines(spark, path).where(kind_of.isin("user", "assistant", "system")).withColumn("content", content).withColumn("kind", kind)
    role = F.when(F.col("kind") == "tool_result", "tool").when(F.col("kind").isin("notice", "compaction_boundary"), "system").otherwise(kind_of)
    origin = F.when(F.col("kind") == "prompt", "human").when(F.col("kind") == "reply", "model").otherwise("harness")
    return numbered(rows.select(
        "file", "block", "at", F.coalesce(get(v, "$.sessionId"), stem(F.col("file"))).alias("session_id"), get(v, "$.uuid").alias("id"),
        get(v, "$.parentUuid").alias("parent_id"), role.alias("role"), "kind", origin.alias("origin"), F.try_to_timestamp(get(v, "$.timestamp")).alias("ts"),
        get(v, "$.message.model").alias("model"), "content", F.when(get(v, "$.message.usage", "variant").isNotNull(), usage.cast(USAGE)).alias("usage"),
    ))


def codex_item(v: Column, base: str) -> tuple[Column, Column, Column]:
    """(content, role, kind) of a response item whose fields stand under the path ``base``."""
    item = get(v, base + "type")
    message, call, result = item == "message", item.isin("function_call", "custom_tool_call"), item.isin("function_call_output", "custom_tool_call_output")
    thought = item == "reasoning"
    role_of = get(v, base + "role")
    nothing = F.lit(None).cast("string")

    def one(kind: str, text: Column, id_: Column, name: Column, input_: Column, use: Column) -> Column:
        return F.array(F.struct(F.lit(kind), text, id_, name, input_, use, F.lit(None).cast("boolean")).cast(BLOCK))

    content = (
        F.when(message, one("text", text_of(get(v, base + "content", "variant")), nothing, nothing, nothing, nothing))
        .when(call, one("tool_use", nothing, get(v, base + "call_id"), get(v, base + "name"), F.coalesce(get(v, base + "arguments"), get(v, base + "input")), nothing))
        .when(result, one("tool_result", text_of(get(v, base + "output", "variant")), nothing, nothing, nothing, get(v, base + "call_id")))
        .when(thought, one("thinking", text_of(get(v, base + "summary", "variant")), nothing, nothing, nothing, nothing))
        .otherwise(F.array().cast(f"array<{BLOCK}>"))
    )
    role = F.when(result, "tool").when(call | thought, "assistant").when(message & (role_of == "developer"), "system").when(message, role_of).otherwise("system")
    kind = F.when(result, "tool_result").when(call | thought | (message & (role_of == "assistant")), "reply").when(message & (role_of == "user"), "prompt").otherwise("notice")
    return content, role, kind


def read_codex(spark: SparkSession, path: str) -> DataFrame:
    """Rollout files, compressed ones too. Cached input tokens are part of the input there and are made disjoint."""
    v = F.col("v")
    nothing = F.lit(None).cast("string")
    content, role, kind = codex_item(v, "$.payload.")
    used = get(v, "$.payload.info.last_token_usage.input_tokens", "bigint")
    cached = F.coalesce(get(v, "$.payload.info.last_token_usage.cached_input_tokens", "bigint"), F.lit(0).cast("bigint"))
    usage = F.struct(nothing, used - cached, get(v, "$.payload.info.last_token_usage.output_tokens", "bigint"), cached, F.lit(None).cast("bigint")).cast(USAGE)
    rows = lines(spark, path).where(get(v, "$.type").isin("session_meta", "response_item", "event_msg", "compacted"))
    own = F.first(F.when(get(v, "$.type") == "session_meta", get(v, "$.payload.id")), ignorenulls=True).over(Window.partitionBy("file"))
    rows = rows.withColumn("session_id", F.coalesce(own, stem(F.col("file")))).where(get(v, "$.type") != "session_meta")
    origin = F.when(F.col("kind") == "prompt", "human").when(F.col("kind") == "reply", "model").otherwise("harness")
    return numbered(rows.select(
        "file", "block", "at", "session_id", nothing.alias("id"), nothing.alias("parent_id"), role.alias("role"), kind.alias("kind"),
        F.try_to_timestamp(get(v, "$.timestamp")).alias("ts"), nothing.alias("model"), content.alias("content"), F.when(used.isNotNull(), usage).alias("usage"),
    ).withColumn("origin", origin))


def read_opensession(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Interchange documents, one JSON document a file."""
    whole = path if isinstance(path, DataFrame) else spark.read.text(path, wholetext=True)
    files = whole.select(F.try_parse_json("value").alias("v"))
    v, m = F.col("v"), F.col("m")
    turns = files.select(get(v, "$.id").alias("session_id"), F.posexplode(get(v, "$.messages", "array<variant>")).alias("msg_idx", "m"))
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    usage = F.struct(F.lit(None).cast("string"), *[get(m, f"$.usage.{n}", "bigint") for n in names]).cast(USAGE)
    return turns.select(
        "session_id", F.col("msg_idx").cast("long").alias("msg_idx"), get(m, "$.id").alias("id"), get(m, "$.parent_id").alias("parent_id"), get(m, "$.role").alias("role"),
        get(m, "$.kind").alias("kind"), get(m, "$.origin").alias("origin"), F.try_to_timestamp(get(m, "$.timestamp")).alias("ts"), get(m, "$.model").alias("model"),
        blocks(get(m, "$.content", "variant")).alias("content"), F.when(get(m, "$.usage", "variant").isNotNull(), usage).alias("usage"),
    )


def tool_events(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, ts, call_id, tool, input, failed): tool calls with their results by id; unanswered calls have failed null."""
    parts = messages.select("session_id", "msg_idx", "ts", F.explode("content").alias("b"))
    calls = parts.where("b.type = 'tool_use'").select("session_id", "msg_idx", "ts", F.col("b.id").alias("call_id"), F.col("b.name").alias("tool"), F.col("b.input").alias("input"))
    results = parts.where("b.type = 'tool_result'").groupBy("session_id", F.col("b.tool_use_id").alias("call_id")).agg(F.bool_or(F.coalesce("b.is_error", F.lit(False))).alias("failed"))
    return calls.join(results, ["session_id", "call_id"], "left").select("session_id", "msg_idx", "ts", "call_id", "tool", "input", "failed")
