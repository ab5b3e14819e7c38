"""Writing messages back as transcript records and documents, one text column a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claude_lines(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, value): JSONL records; ``value`` in order of msg_idx is a session's file."""
    role = F.when(F.col("role").isin("assistant", "system"), F.col("role")).otherwise("user")
    content = F.to_json(F.transform("content", part))
    fields = {
        "type": F.to_json(F.struct(role.alias("x"))), "uuid": json_field("id"), "parentUuid": json_field("parent_id"), "sessionId": json_field("session_id"),
        "timestamp": F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("x"))),
    }
    parts = [F.when(F.get_json_object(v, "$.x").isNotNull(), F.concat(F.lit(f'"{k}":'), F.regexp_extract(v, r'(?s)^\{"x":(.*)\}$', 1))) for k, v in fields.items()]
    summary = F.when(F.col("kind") == "compaction_summary", F.lit('"isCompactSummary":true')).when(F.col("kind") == "compaction_boundary", F.lit('"subtype":"compact_boundary"'))
    model = F.when(F.col("model").isNotNull(), F.concat(F.lit('"model":'), F.regexp_extract(json_field("model"), r'(?s)^\{"x":(.*)\}$', 1)))
    message = F.concat(F.lit('"message":{'), F.concat_ws(",", F.concat(F.lit('"role":"'), role, F.lit('"')), model, F.concat(F.lit('"content":'), content)), F.lit("}"))
    return messages.select("session_id", "msg_idx", F.concat(F.lit("{"), F.concat_ws(",", *parts, summary, message), F.lit("}")).alias("value"))


def json_field(column: str) -> Column:
    return F.to_json(F.struct(F.col(column).alias("x")))


def part(b: Column) -> Column:
    """A block as a record's part: its type and the fields that type has."""
    kind = b["type"]
    result = kind == "tool_result"
    return F.struct(
        kind.alias("type"), F.when(kind == "text", b["text"]).alias("text"), F.when(kind == "thinking", b["text"]).alias("thinking"), b["id"].alias("id"),
        b["name"].alias("name"), F.when(kind == "tool_use", F.try_parse_json(b["input"])).alias("input"), b["tool_use_id"].alias("tool_use_id"),
        F.when(result, b["text"]).alias("content"), b["is_error"].alias("is_error"),
    )


def markdown(messages: DataFrame) -> DataFrame:
    """(session_id, value): one document a session, a heading a message and its texts."""
    texts = F.array_join(F.filter(F.transform("content", lambda b: b["text"]), lambda t: t.isNotNull()), "\n\n")
    section = F.concat(F.lit("## "), "role", F.lit("\n\n"), texts)
    ordered = F.sort_array(F.collect_list(F.struct("msg_idx", section.alias("s"))))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n").alias("value"))


def fidelity(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, before, after, lost): blocks of each type on both sides of a conversion."""

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode("content").alias("b")).groupBy(F.col("b.type").alias("kind")).agg(F.count("*").alias(name))

    both = tally(before, "before").join(tally(after, "after"), "kind", "full").na.fill(0, ["before", "after"])
    return both.withColumn("lost", F.greatest(F.col("before") - F.col("after"), F.lit(0)))


def in_sessions(messages: DataFrame, message: Column) -> DataFrame:
    """(session_id, turns): each session's messages, given as structs, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("msg_idx", F.to_json(message).alias("m"))))
    return messages.groupBy("session_id").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["m"]), ","), F.lit("]")).alias("turns"))


def instant() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def document(head: str, turns: str) -> Column:
    """One JSON document: the session's id under ``head``, its messages under ``turns``."""
    return F.concat(F.lit(f'{{"{head}":'), F.regexp_extract(json_field("session_id"), r'(?s)^\{"x":(.*)\}$', 1), F.lit(f',"{turns}":'), F.col("turns"), F.lit("}"))


def opensession_documents(messages: DataFrame) -> DataFrame:
    """(session_id, value): an interchange document for each session, which ``read_opensession`` reads back."""
    usage = F.when(F.col("usage").isNotNull(), F.struct(
        F.col("usage.input").alias("input_tokens"), F.col("usage.output").alias("output_tokens"), F.col("usage.cache_read").alias("cache_read_tokens"), F.col("usage.cache_creation").alias("cache_creation_tokens"),
    ))
    message = F.struct("id", "parent_id", "role", "kind", "origin", instant().alias("timestamp"), "model", F.transform("content", part).alias("content"), usage.alias("usage"))
    return in_sessions(messages, message).select("session_id", document("id", "messages").alias("value"))


def google_part(b: Column) -> Column:
    kind = b["type"]
    call = F.struct(b["id"].alias("id"), b["name"].alias("name"), F.try_parse_json(b["input"]).alias("args"))
    answer = F.struct(b["tool_use_id"].alias("id"), F.coalesce(F.try_parse_json(b["text"]), F.parse_json(F.to_json(F.struct(b["text"].alias("output"))))).alias("response"))
    return F.struct(
        F.when(kind.isin("text", "thinking"), b["text"]).alias("text"), F.when(kind == "thinking", True).alias("thought"),
        F.when(kind == "tool_use", call).alias("functionCall"), F.when(kind == "tool_result", answer).alias("functionResponse"),
    )


def gemini_documents(messages: DataFrame) -> DataFrame:
    """(session_id, value): chat recordings. Results stand as parts of the message that holds them."""
    kind = F.when(F.col("role") == "assistant", "gemini").when(F.col("role").isin("user", "tool"), "user").otherwise("info")
    message = F.struct("id", instant().alias("timestamp"), kind.alias("type"), "model", F.transform("content", google_part).alias("content"))
    return in_sessions(messages, message).select("session_id", document("sessionId", "messages").alias("value"))


def qwen_lines(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, value): session lines."""
    kind = F.when(F.col("role") == "tool", "tool_result").otherwise(F.col("role"))
    record = F.struct(
        F.col("id").alias("uuid"), F.col("parent_id").alias("parentUuid"), F.col("session_id").alias("sessionId"), instant().alias("timestamp"), kind.alias("type"), "model",
        F.struct(F.transform("content", google_part).alias("parts")).alias("message"),
    )
    return messages.select("session_id", "msg_idx", F.to_json(record).alias("value"))


def cline_documents(messages: DataFrame) -> DataFrame:
    """(session_id, value): task histories; notices of the harness have no place there."""
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    return in_sessions(messages.where("role <> 'system'"), F.struct(role.alias("role"), F.transform("content", part).alias("content"))).select("session_id", F.col("turns").alias("value"))


def field_fidelity(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = ("id", "parent_id", "ts", "model", "usage", "kind", "origin")) -> DataFrame:
    """(field, before, after, lost): messages that hold each field on both sides of a conversion."""

    def tally(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.count(f).alias(f) for f in fields])
        return one.select(F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", name))

    both = tally(before, "before").join(tally(after, "after"), "field")
    return both.withColumn("lost", F.greatest(F.col("before") - F.col("after"), F.lit(0)))


def as_json(**fields: Column) -> Column:
    """A JSON object of the fields given; null ones are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def headed(messages: DataFrame, head: Column, lines_: DataFrame) -> DataFrame:
    """``lines_`` (session_id, msg_idx, part, value) below one first line for each session, numbered anew by ``msg_idx``."""
    from pyspark.sql import Window

    first = messages.groupBy("session_id").agg(F.min("ts").alias("ts")).select("session_id", F.lit(-1).cast("long").alias("msg_idx"), F.lit(0).alias("part"), head.alias("value"))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx", "part")) - 1
    return first.unionByName(lines_).select("session_id", at.cast("long").alias("msg_idx"), "value")


def codex_lines(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, value): rollout lines, one item a block. Ids of messages, models and images have no place there."""
    b, kind = F.col("b"), F.col("b.type")
    name = F.when(F.col("role") == "assistant", "output_text").otherwise("input_text")
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).when(F.col("role") == "tool", "user").otherwise("developer")
    typed = lambda t: F.array(F.struct(t.alias("type"), b["text"].alias("text")))
    no_parts, no_role = F.lit(None).cast("array<struct<type:string,text:string>>"), F.lit(None).cast("string")
    item = F.when(kind == "thinking", F.struct(F.lit("reasoning").alias("type"), no_role.alias("role"), no_parts.alias("content"), typed(F.lit("summary_text")).alias("summary"), *_codex_call(None)))
    item = item.when(kind == "tool_use", F.struct(F.lit("function_call").alias("type"), no_role.alias("role"), no_parts.alias("content"), no_parts.alias("summary"), *_codex_call("call")))
    item = item.when(kind == "tool_result", F.struct(F.lit("function_call_output").alias("type"), no_role.alias("role"), no_parts.alias("content"), no_parts.alias("summary"), *_codex_call("result")))
    item = item.when(kind == "text", F.struct(F.lit("message").alias("type"), role.alias("role"), typed(name).alias("content"), no_parts.alias("summary"), *_codex_call(None)))
    spread = messages.select("session_id", "msg_idx", "role", "ts", F.posexplode("content").alias("part", "b")).withColumn("item", item).where("item IS NOT NULL")
    value = as_json(timestamp=instant(), type=F.lit("response_item"), payload=F.col("item"))
    head = as_json(timestamp=instant(), type=F.lit("session_meta"), payload=F.struct(F.col("session_id").alias("id")))
    return headed(messages, head, spread.select("session_id", "msg_idx", "part", value.alias("value")))


def _codex_call(side: str | None) -> list[Column]:
    """call_id, name, arguments and output of an item: a call's, a result's or nobody's."""
    b, nothing = F.col("b"), F.lit(None).cast("string")
    of = {"call": (b["id"], b["name"], b["input"], nothing), "result": (b["tool_use_id"], nothing, nothing, F.coalesce(b["text"], F.lit("")))}.get(side, (nothing,) * 4)
    return [c.alias(n) for c, n in zip(of, ("call_id", "name", "arguments", "output"))]


def tree_part(b: Column) -> Column:
    """A block as a part of a tree file's message."""
    kind = b["type"]
    return F.struct(
        F.when(kind == "tool_use", "toolCall").otherwise(kind).alias("type"), F.when(kind == "text", b["text"]).alias("text"), F.when(kind == "thinking", b["text"]).alias("thinking"),
        F.when(kind == "tool_use", b["id"]).alias("id"), b["name"].alias("name"), F.when(kind == "tool_use", F.try_parse_json(b["input"])).alias("arguments"),
    )


def openclaw_lines(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, value): tree lines of version 3, one a message, but one for each result; what a message says beside its results comes after them.

    The first line that a message becomes hangs on the message's parent, each other on the line before it, and replies to a message on its last one, which has its id.
    """
    own = messages.select("*", F.when(F.exists("content", lambda b: b["type"] == "tool_result"), F.filter("content", lambda b: b["type"] == "tool_result")).alias("_results"))
    rest = F.filter("content", lambda b: b["type"] != "tool_result")
    last = F.size(rest) > 0
    count = F.coalesce(F.size("_results"), F.lit(0))
    pieces = own.withColumn("_n", F.greatest(count, F.lit(0)) + F.when(last | (F.greatest(count, F.lit(0)) == 0), 1).otherwise(0)).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    result = F.get(F.col("_results"), F.col("part") - 1)
    is_result = F.col("part") <= F.greatest(count, F.lit(0))
    sub = lambda n: F.when(n == F.col("_n"), F.col("id")).otherwise(F.concat("id", F.lit("."), n.cast("string")))
    role = F.when(is_result, "toolResult").when(F.col("kind") == "compaction_summary", "compactionSummary").when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("custom")
    parts = F.when(is_result, F.array(F.struct(F.lit("text").alias("type"), F.coalesce(result["text"], F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("thinking", "string"), ("id", "string"), ("name", "string"), ("arguments", "variant"))])))
    content = parts.otherwise(F.when(role != "compactionSummary", F.transform(rest, tree_part)))
    u = F.col("usage")
    usage = F.when(u.isNotNull() & (F.col("part") == F.col("_n")), F.struct(*[u[a].alias(n) for a, n in (("input", "input"), ("output", "output"), ("cache_read", "cacheRead"), ("cache_creation", "cacheWrite"))]))
    message = F.struct(
        role.alias("role"), content.alias("content"), F.when(is_result, result["tool_use_id"]).alias("toolCallId"), F.when(is_result, result["is_error"]).alias("isError"), F.when(~is_result, F.col("model")).alias("model"),
        F.when(role == "compactionSummary", F.get(rest, F.lit(0))["text"]).alias("summary"), usage.alias("usage"), u["response_id"].alias("responseId"),
    )
    value = as_json(type=F.lit("message"), id=sub(F.col("part")), parentId=F.when(F.col("part") == 1, F.col("parent_id")).otherwise(sub(F.col("part") - 1)), timestamp=instant(), message=message)
    head = as_json(type=F.lit("session"), version=F.lit(3), id=F.col("session_id"), timestamp=instant())
    return headed(messages, head, pieces.select("session_id", "msg_idx", "part", value.alias("value")))


def grok_lines(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, value): lines of a session's ``chat_history.jsonl``; a message's thoughts and results are lines of their own before it. Ids, times and usage have no place there."""
    rest = F.filter("content", lambda b: b["type"].isin("text", "tool_use"))
    text = F.array_join(F.filter(F.transform(F.filter(rest, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t.isNotNull()), "\n")
    calls = F.transform(F.filter(rest, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("arguments")))
    kind = F.when(F.col("role").isin("assistant", "system"), F.col("role")).otherwise("user")
    made_up = F.when((kind == "user") & (F.col("kind") != "prompt"), F.col("kind"))
    said = as_json(type=kind, content=text, model_id=F.col("model"), synthetic_reason=made_up, tool_calls=F.when(F.size(calls) > 0, calls))
    whole = messages.where(F.size(rest) > 0).select("session_id", "msg_idx", F.lit(1_000_000).alias("part"), said.alias("value"))
    spread = messages.select("session_id", "msg_idx", F.posexplode("content").alias("part", "b"))
    thought = as_json(type=F.lit("reasoning"), summary=F.array(F.struct(F.lit("summary_text").alias("type"), F.col("b.text").alias("text"))))
    result = as_json(type=F.lit("tool_result"), tool_call_id=F.col("b.tool_use_id"), content=F.coalesce("b.text", F.lit("")))
    alone = spread.withColumn("value", F.when(F.col("b.type") == "thinking", thought).when(F.col("b.type") == "tool_result", result)).where("value IS NOT NULL").select("session_id", "msg_idx", "part", "value")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx", "part")) - 1
    return whole.unionByName(alone).select("session_id", at.cast("long").alias("msg_idx"), "value")


def texts(column: str = "content") -> Column:
    return F.array_join(F.filter(F.transform(F.filter(column, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t.isNotNull()), "\n")


def continue_documents(messages: DataFrame) -> DataFrame:
    """(session_id, value): session documents in the openai shape. Results stand as states of their message's calls; thoughts have no place there."""
    calls = F.transform(F.filter("content", lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), F.lit("function").alias("type"), F.struct(b["name"].alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("arguments")).alias("function")))
    states = F.transform(
        F.filter("content", lambda b: b["type"] == "tool_result"),
        lambda b: F.struct(b["tool_use_id"].alias("toolCallId"), F.when(b["is_error"], "errored").otherwise("done").alias("status"), F.array(F.struct(F.lit("text").alias("type"), b["text"].alias("text"))).alias("output")),
    )
    role = F.when(F.col("role") == "tool", "user").otherwise(F.col("role"))
    message = F.struct(F.struct(role.alias("role"), texts().alias("content"), F.when(F.size(calls) > 0, calls).alias("toolCalls")).alias("message"), F.when(F.size(states) > 0, states).alias("toolCallStates"))
    return in_sessions(messages, message).select("session_id", document("sessionId", "history").alias("value"))


def lmstudio_documents(messages: DataFrame) -> DataFrame:
    """(session_id, value): conversations, a version a message and a step a text or thought. Calls and results have no place there."""
    steps = F.transform(
        F.filter("content", lambda b: b["type"].isin("text", "thinking")),
        lambda b: F.struct(F.lit("contentBlock").alias("type"), F.when(b["type"] == "thinking", F.struct(F.lit("thinking").alias("type"))).alias("style"), F.array(F.struct(F.lit("text").alias("type"), b["text"].alias("text"))).alias("content")),
    )
    role = F.when(F.col("role") == "tool", "user").otherwise(F.col("role"))
    message = F.struct(F.array(F.struct(F.lit("multiStep").alias("type"), role.alias("role"), steps.alias("steps"))).alias("versions"), F.lit(0).alias("currentlySelected"))
    return in_sessions(messages.where(F.size(steps) > 0), message).select("session_id", document("name", "messages").alias("value"))


def share_pages(messages: DataFrame, classes: list[str] | None = None, styles: str = "body{font:15px sans-serif;max-width:50em;margin:auto}pre{white-space:pre-wrap}") -> DataFrame:
    """(session_id, value): one HTML page a session that needs nothing beside it, with secrets redacted and every text escaped.

    Calls and results fold away. Redaction is over each block as a whole, before escaping, so a mark can't be split.
    """
    from threadloom.functions.redaction import redact

    def escaped(c: Column) -> Column:
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(entity))
        return c

    kind = F.col("b.type")
    spread = messages.select("session_id", "msg_idx", "role", F.posexplode_outer("content").alias("part", "b"))
    text = escaped(redact(F.coalesce("b.text", "b.input", F.lit("")), classes))
    label = F.when(kind == "tool_use", F.concat(F.lit("call "), escaped(F.coalesce("b.name", F.lit(""))))).when(kind == "tool_result", "result").when(kind == "thinking", "thinking")
    body = F.when(label.isNull(), F.concat(F.lit("<pre>"), text, F.lit("</pre>"))).otherwise(F.concat(F.lit("<details><summary>"), label, F.lit("</summary><pre>"), text, F.lit("</pre></details>")))
    whole = spread.groupBy("session_id", "msg_idx").agg(F.max("role").alias("role"), F.sort_array(F.collect_list(F.struct("part", body.alias("h")))).alias("_p"))
    section = F.concat(F.lit('<section id="m'), F.col("msg_idx").cast("string"), F.lit('"><h2>'), escaped(F.coalesce("role", F.lit(""))), F.lit("</h2>"), F.array_join(F.transform("_p", lambda x: x["h"]), ""), F.lit("</section>"))
    ordered = F.sort_array(F.collect_list(F.struct("msg_idx", section.alias("s"))))
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escaped(F.col("session_id")), F.lit(f"</title><style>{styles}</style></head><body>"))
    return whole.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n").alias("_b")).select("session_id", F.concat(head, "_b", F.lit("</body></html>")).alias("value"))


#: writers by the agent whose shape they give; ``read_`` functions of the same names read them back
TARGETS = {
    "claude": claude_lines, "codex": codex_lines, "grok": grok_lines, "openclaw": openclaw_lines, "gemini": gemini_documents, "qwen": qwen_lines, "lmstudio": lmstudio_documents,
    "cline": cline_documents, "roo": cline_documents, "continue": continue_documents, "opensession": opensession_documents,
}


def emitted(messages: DataFrame, target: str) -> DataFrame:
    """``messages`` in another agent's shape; agents that can only be read are an error."""
    if target not in TARGETS:
        raise ValueError(f"can't write {target!r}; there are {', '.join(sorted(TARGETS))}")
    return TARGETS[target](messages)


def write_sessions(values: DataFrame, path: str) -> None:
    """Writes ``values`` as text, a folder ``session_id=...`` for each session with its lines in order in one file; sessions are spread over all tasks."""
    held = values.repartition("session_id")
    order = ["session_id", "msg_idx"] if "msg_idx" in values.columns else ["session_id"]
    held.sortWithinPartitions(*order).select("session_id", "value").write.partitionBy("session_id").text(path)
