"""Identifiers: version-7 times, shortest unique prefixes, actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid7_time(value: Column) -> Column:
    """Instant of a version-7 identifier (its first 48 bits are milliseconds), null for others."""
    digits = F.regexp_replace(F.lower(value), "-", "")
    millis = F.conv(F.substring(digits, 1, 12), 16, 10).cast("long")
    return F.when(digits.rlike("^[0-9a-f]{12}7[0-9a-f]{19}$"), F.timestamp_millis(millis))


def short_ids(rows: DataFrame, column: str, least: int = 8) -> DataFrame:
    """(id, short): each distinct id's shortest prefix of ``least`` characters or more that no other id has.

    Prefixes of all lengths are counted in one grouped pass, so no window holds all ids.
    """
    ids = rows.select(F.col(column).alias("id")).where("id IS NOT NULL").distinct()
    ends = F.sequence(F.least(F.lit(least), F.char_length("id")), F.char_length("id"))
    spread = ids.select("id", F.explode(F.transform(ends, lambda n: F.substr("id", F.lit(1), n))).alias("short"))
    alone = spread.groupBy("short").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    best = alone.groupBy("id").agg(F.min_by("short", F.char_length("short")).alias("short"))
    return ids.join(best, "id", "left").select("id", F.coalesce("short", "id").alias("short"))


def actor(name: Column) -> Column:
    """``web:x`` and ``x`` are one actor."""
    return F.regexp_replace(name, "^web:", "")
