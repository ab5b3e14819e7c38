"""All sources together: one table of sessions over many stores, and the stores that couldn't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources import agents as A
from threadloom.sources import documents as D
from threadloom.sources import jsonl as J

READERS = {
    "claude": J.read_claude, "codex": J.read_codex, "opensession": J.read_opensession, "gemini": D.read_gemini, "qwen": D.read_qwen, "pi": D.read_pi, "continue": D.read_continue,
    "lmstudio": D.read_lmstudio, "cline": D.read_cline, "roo": D.read_cline, "kimi": D.read_kimi, "claude-export": D.read_claude_export, "chatgpt-export": D.read_chatgpt_export,
    "codex-2025": A.read_codex_document, "openclaw": A.read_openclaw, "grok": A.read_grok, "kimi-code": A.read_kimi_code,
}


def discover_all(spark: SparkSession, stores: list[tuple[str, str]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Messages of all ``stores`` (harness, path) with their harness, (None if no store can be read), and why a store gives none: an unknown harness or a path that isn't there.

    Only listing a path is checked here; what its files hold is read with the query.
    """
    found, failed = [], {}
    for harness, path in stores:
        if harness not in READERS:
            failed[path] = f"unknown harness {harness!r}"
            continue
        try:
            found.append(READERS[harness](spark, path).withColumn("harness", F.lit(harness)))
        except Exception as e:  # Spark tells a missing path by several kinds
            failed[path] = str(e).splitlines()[0][:200]
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return out, failed


def session_rows(messages: DataFrame) -> DataFrame:
    """(harness, session_id, title, models, created, updated, n_messages, input, output) of ``messages``."""
    text = F.array_join(F.transform(F.filter("content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    prompt = F.when(F.col("kind") == "prompt", F.col("msg_idx"))
    return messages.withColumn("said", text).groupBy("harness", "session_id").agg(
        F.min_by("said", prompt).alias("title"), F.sort_array(F.collect_set("model")).alias("models"), F.min("ts").alias("created"), F.max("ts").alias("updated"),
        F.count_if(F.col("role").isin("user", "assistant")).alias("n_messages"), F.sum("usage.input").alias("input"), F.sum("usage.output").alias("output"),
    )
