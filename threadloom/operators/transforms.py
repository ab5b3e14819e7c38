"""Reshaping message streams: datasets, pruning, splicing, rewinding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Dataset roles by format.
SHAREGPT = {"system": "system", "user": "human", "assistant": "gpt", "tool": "tool"}


def dataset(messages: DataFrame, fmt: str = "chatml") -> DataFrame:
    """(session_id, record): one JSON training record for each session, turns in order."""
    order = F.sort_array(F.collect_list(F.struct("msg_idx", "role", "text")))
    if fmt == "sharegpt":
        role = F.create_map(*[F.lit(x) for kv in SHAREGPT.items() for x in kv])
        turns = F.transform("turns", lambda m: F.struct(F.get(F.array(role[m["role"]]), F.lit(0)).alias("from"), m["text"].alias("value")))
        record = F.struct(F.col("session_id").alias("id"), turns.alias("conversations"))
    else:
        turns = F.transform("turns", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
        record = F.struct(turns.alias("messages"))
    return messages.groupBy("session_id").agg(order.alias("turns")).select("session_id", F.to_json(record).alias("record"))


def open_calls(messages: DataFrame) -> DataFrame:
    """``messages`` (session_id, msg_idx, calls and results: arrays of call ids, ...) with ``pending``, the calls up to each message without a result so far.

    A call is open from its message to the one before its first result, so each is a range of places, and all
    ranges together are as long as the arrays that come out. Calls stand in the order in which they were made.
    """
    places = lambda c: messages.select("session_id", "msg_idx", F.posexplode(c).alias("_at", "call"))
    made = places("calls").groupBy("session_id", "call").agg(F.min(F.struct("msg_idx", "_at")).alias("_made"))
    closed = places("results").groupBy("session_id", "call").agg(F.min("msg_idx").alias("_closed"))
    ends = messages.groupBy("session_id").agg((F.max("msg_idx") + 1).alias("_end"))
    ranges = made.join(closed, ["session_id", "call"], "left").join(ends, "session_id")
    start, stop = F.col("_made.msg_idx"), F.coalesce("_closed", "_end") - 1
    spread = ranges.where(start <= stop).select("session_id", "call", "_made", F.explode(F.sequence(start, stop)).alias("msg_idx"))
    lists = spread.groupBy("session_id", "msg_idx").agg(F.sort_array(F.collect_list(F.struct("_made", "call"))).alias("_open"))
    none = F.array().cast("array<string>")
    return messages.join(lists, ["session_id", "msg_idx"], "left").withColumn("pending", F.coalesce(F.transform("_open", lambda x: x["call"]), none)).drop("_open")


def clean_outcomes(messages: DataFrame) -> DataFrame:
    """Sessions without an error record whose last message with text is the assistant's.

    With columns calls, results and failed (arrays of call ids), also without a call that has no result, or a failed one
    after which no result succeeded.
    """
    said = F.when(F.trim("text") != "", F.col("msg_idx"))
    tests = [F.bool_or(F.col("kind") == "error").alias("broken"), F.max_by("role", said).alias("last")]
    if {"calls", "results", "failed"} <= set(messages.columns):
        ids = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))
        bad = F.coalesce(F.size("failed"), F.lit(0)) > 0
        good = F.size(F.array_except("results", F.coalesce("failed", F.array().cast("array<string>")))) > 0
        unsolved = F.coalesce(F.max(F.when(bad, F.col("msg_idx"))), F.lit(-1)) > F.coalesce(F.max(F.when(good, F.col("msg_idx"))), F.lit(-1))
        tests += [(F.size(F.array_except(ids("calls"), ids("results"))) > 0).alias("pending"), unsolved.alias("unsolved")]
    held = messages.groupBy("session_id").agg(*tests).where("NOT broken AND last = 'assistant'")
    return (held.where("NOT pending AND NOT unsolved") if "pending" in held.columns else held).select("session_id")


def prune(messages: DataFrame, min_size: int = 2048, keep_last: int = 25) -> tuple[DataFrame, DataFrame]:
    """Messages with texts over ``min_size`` characters outside the last turns replaced by a marker, and the sidecar of what went."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("msg_idx").desc()))
    held = messages.withColumn("_back", back)
    goes = (F.col("_back") > keep_last) & (F.char_length("text") > min_size)
    name = F.substring(F.sha2("text", 256), 1, 16)
    marker = F.concat(F.lit("[PRUNED id="), name, F.lit(" bytes="), F.octet_length("text").cast("string"), F.lit("]"))
    pruned = held.withColumn("text", F.when(goes, marker).otherwise(F.col("text"))).drop("_back")
    sidecar = held.where(goes).select("session_id", "msg_idx", name.alias("id"), "text")
    return pruned, sidecar


def retrieve(pruned: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Pruned messages with their texts put back."""
    name = F.regexp_extract("text", r"^\[PRUNED id=([0-9a-f]+) ", 1)
    back = sidecar.select("session_id", "msg_idx", "id", F.col("text").alias("_full"))
    joined = pruned.withColumn("id", name).join(back, ["session_id", "msg_idx", "id"], "left")
    return joined.withColumn("text", F.coalesce("_full", "text")).drop("_full", "id")


def splice(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """Windows of sessions one after another (spans: ord, session_id, start, stop), renumbered, with their origin.

    A message's new number is its place in its span and the sizes of the spans before it, so only the
    sizes, one row a span, are ordered together.
    """
    parts = messages.join(spans, "session_id").where((F.col("msg_idx") >= F.col("start")) & (F.col("msg_idx") < F.col("stop")))
    sizes = parts.groupBy("ord").agg(F.count("*").alias("n"))
    before = sizes.select("ord", (F.sum("n").over(Window.orderBy("ord")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("ord").orderBy("msg_idx")) - 1
    placed = parts.withColumn("at", at).join(before, "ord")
    return placed.select((F.col("before") + F.col("at")).cast("long").alias("new_idx"), F.col("session_id").alias("from_session"), F.col("msg_idx").alias("from_idx"), "role", "text")


def rewind(messages: DataFrame, cut: int, boundary) -> DataFrame:
    """Messages of each session from its last boundary at or before ``cut`` through ``cut``.

    With columns calls and results the end moves on to the message that answers the last call made by then.
    """
    own = Window.partitionBy("session_id")
    last = F.max(F.when(boundary & (F.col("msg_idx") <= cut), F.col("msg_idx"))).over(own)
    kept = messages.withColumn("_from", F.coalesce(last, F.lit(0)))
    end = F.lit(cut)
    if {"calls", "results"} <= set(messages.columns):
        made = messages.where(F.col("msg_idx") <= cut).select("session_id", F.explode("calls").alias("call")).distinct()
        answered = messages.select("session_id", "msg_idx", F.explode("results").alias("call"))
        closed = answered.join(made, ["session_id", "call"]).groupBy("session_id").agg(F.max("msg_idx").alias("_closed"))
        kept = kept.join(closed, "session_id", "left")
        end = F.greatest(F.lit(cut), F.coalesce("_closed", F.lit(cut)))
    return kept.where((F.col("msg_idx") >= F.col("_from")) & (F.col("msg_idx") <= end)).select(*messages.columns)


def prompts_and_answers(messages: DataFrame) -> DataFrame:
    """Each prompt with the last reply before the next prompt."""
    span = F.count_if(F.col("kind") == "prompt").over(Window.partitionBy("session_id").orderBy("msg_idx"))
    by_span = messages.withColumn("span", span).where("span > 0").groupBy("session_id", "span")
    reply = F.when(F.col("kind") == "reply", F.col("msg_idx"))
    return by_span.agg(F.min_by("text", "msg_idx").alias("prompt"), F.max_by("text", reply).alias("answer"))


def threads(messages: DataFrame) -> DataFrame:
    """(id, depth) of each message below its root by parent id; a message whose parent is absent is a root, those of a cycle have no depth."""
    from threadloom.operators.graphs import depths

    return depths(messages).select("id", "depth")


def restamped(messages: DataFrame, session: str) -> DataFrame:
    """``messages`` (session_id, id, parent_id, ...) as another session's: new ids from the old ones, links kept, the origin noted."""
    renamed = lambda c: F.when(F.col(c).isNotNull(), F.substring(F.sha2(F.concat(F.lit(session + "/"), F.col(c)), 256), 1, 32))
    return messages.withColumns({"origin_session": F.col("session_id"), "session_id": F.lit(session), "id": renamed("id"), "parent_id": renamed("parent_id")})


def thinking(messages: DataFrame, policy: str = "drop") -> DataFrame:
    """Reasoning texts (column thinking) dropped, kept, or put before the text in tags."""
    if policy not in ("drop", "keep", "inline"):
        raise ValueError(f"no thinking policy: {policy!r}")
    if policy == "keep":
        return messages
    if policy == "inline":
        said = F.coalesce(F.trim("thinking"), F.lit("")) != ""
        messages = messages.withColumn("text", F.when(said, F.concat(F.lit("<think>"), F.col("thinking"), F.lit("</think>\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    return messages.drop("thinking")
