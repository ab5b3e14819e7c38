"""Turning conversation rows into the message model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kind and origin of a message whose source gives only a role.
ROLE_KIND = {"user": "prompt", "assistant": "reply", "tool": "tool_result", "system": "notice"}
ROLE_ORIGIN = {"user": "human", "assistant": "model", "tool": "harness", "system": "harness"}


def lookup(column, table: dict):
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def messages_from_conversations(rows: DataFrame) -> DataFrame:
    """(session_id, msg_idx, role, kind, origin, text) from (conv_id, turn, role, text)."""
    return rows.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("msg_idx"), "role",
        lookup(F.col("role"), ROLE_KIND).alias("kind"), lookup(F.col("role"), ROLE_ORIGIN).alias("origin"), "text",
    )
