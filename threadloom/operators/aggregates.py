"""Aggregations over sessions, usage rows and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus_stats(rows: DataFrame, count: str, created: str, updated: str) -> DataFrame:
    """One row: sessions, counted messages, uncounted sessions, first and last instant."""
    return rows.agg(
        F.count("*").alias("sessions"), F.sum(count).cast("long").alias("messages"), F.count_if(F.col(count).isNull()).alias("uncounted"),
        F.min(created).alias("first"), F.max(updated).alias("last"),
    )


def top_groups(rows: DataFrame, key: Column, limit: int, absent: str = "(none)") -> DataFrame:
    """The ``limit`` most frequent values of ``key``, ties by value; nulls are ``absent``."""
    named = F.coalesce(key.cast("string"), F.lit(absent)).alias("name")
    return rows.groupBy(named).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(limit)


def usage_totals(rows: DataFrame, by: list[str], tokens: list[str], cost: str) -> DataFrame:
    """Calls, token sums and reported cost (null if no row reports one) at every level of ``by``, '*' for all."""
    sums = [F.sum(c).alias(c) for c in tokens]
    level = rows.rollup(*by).agg(F.count("*").alias("calls"), *sums, F.sum(cost).alias(cost), *[F.grouping(c).alias(f"_{c}") for c in by])
    names = [F.when(F.col(f"_{c}") == 1, F.lit("*")).otherwise(F.col(c)).alias(c) for c in by]
    return level.select(*names, "calls", *tokens, cost)


def exact_usage(rows: DataFrame, identity: list[str], order: list) -> DataFrame:
    """Usage rows without repeats: a response that comes again under one identity counts where it first stands.

    A row whose identity holds a null is none's repeat.
    """
    whole = F.lit(True)
    for c in identity:
        whole = whole & F.col(c).isNotNull()
    at = F.row_number().over(Window.partitionBy(*identity).orderBy(*order))
    once = rows.where(whole).withColumn("_at", at).where("_at = 1").drop("_at")
    return once.unionByName(rows.where(~whole))


def tool_histogram(events: DataFrame, by: list[str]) -> DataFrame:
    """Calls, file edits, reads, commands and errors of each tool."""
    kind = F.col("kind")
    return events.groupBy(*by).agg(
        F.count_if("call").alias("calls"), F.count_if(kind == "file_edit").alias("edits"), F.count_if(kind == "file_read").alias("reads"),
        F.count_if(kind == "command").alias("commands"), F.count_if(kind == "error").alias("errors"),
    )


def touched(events: DataFrame) -> DataFrame:
    """Edits, reads and last instant of each session and target with an edit."""
    kind = F.col("kind")
    found = events.groupBy("session_id", "target").agg(F.count_if(kind == "file_edit").alias("edits"), F.count_if(kind == "file_read").alias("reads"), F.max("ts").alias("last"))
    return found.where("edits > 0")


def islands(rows: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Runs of consecutive numbers: (by, first, last); repeated numbers count once."""
    once = rows.select(*by, seq).distinct()
    run = F.col(seq) - F.row_number().over(Window.partitionBy(*by).orderBy(seq))
    return once.withColumn("_run", run).groupBy(*by, "_run").agg(F.min(seq).alias("first"), F.max(seq).alias("last")).drop("_run")


def frontier(rows: DataFrame, by: list[str], seq: str) -> DataFrame:
    """For each group the last number reached without a gap from 1 (0 if 1 is missing), the highest, and the gaps."""
    runs = islands(rows, by, seq)
    reached = F.max(F.when(F.col("first") == 1, F.col("last")))
    return runs.groupBy(*by).agg(F.coalesce(reached, F.lit(0)).cast("long").alias("frontier"), F.max("last").alias("highest"), (F.count("*") - F.when(F.min("first") == 1, 1).otherwise(0)).alias("gaps"))


def verified_chain(rows: DataFrame, by: str, domain: str) -> DataFrame:
    """(by, seq, ok): numbers contiguous from 1, each previous hash the one before, each hash that of domain, previous hash and body."""
    w = Window.partitionBy(by).orderBy("seq")
    before = F.coalesce(F.lag("hash").over(w), F.lit(""))
    right = F.sha2(F.concat(F.lit(domain + "\n"), F.col("prev"), F.lit("\n"), F.col("body")), 256) == F.col("hash")
    return rows.select(by, "seq", ((F.col("seq") == F.row_number().over(w)) & (F.col("prev") == before) & right).alias("ok"))


def day_levels(rows: DataFrame, when: str) -> DataFrame:
    """(day, n, level): rows a day and a heat level of 0 to 4 relative to the busiest day."""
    days = rows.groupBy(F.to_date(when).alias("day")).agg(F.count("*").alias("n"))
    most = days.agg(F.max("n").alias("most"))
    return days.join(F.broadcast(most)).select("day", "n", F.least(F.lit(4), F.ceil(4 * F.col("n") / F.col("most"))).cast("int").alias("level"))


def merged_ranges(rows: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """(by, first, last): ranges of one group that overlap or touch become one. A range without a start comes last and joins the one before; one without an end reaches no further."""
    own = Window.partitionBy(*by).orderBy(F.col(first).asc_nulls_last(), F.col(last).asc_nulls_last())
    before = F.max(last).over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(first) > before + 1), 1).otherwise(0)
    named = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*by, "_run").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_run")


def tool_map(events: DataFrame, by: str, tool: str) -> DataFrame:
    """(by, tools): calls of each tool as a map in name order."""
    n = events.groupBy(by, tool).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(tool, "n")))).alias("tools"))


def workflow_totals(runs: DataFrame, by: str, status: str, cost: str, when: str) -> DataFrame:
    """Runs, unfinished runs, cost and the last instant of each workflow; a missing name is its own."""
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.count_if(~F.coalesce(F.col(status) == "F", F.lit(False))).alias("open"), F.sum(cost).alias("cost"), F.max(when).alias("last")
    )


def compactions(rows: DataFrame) -> DataFrame:
    """(session_id, boundaries, summaries, last) of ``rows`` (session_id, msg_idx, kind)."""
    kind = F.col("kind")
    return rows.groupBy("session_id").agg(
        F.count_if(kind == "compaction_boundary").alias("boundaries"), F.count_if(kind == "compaction_summary").alias("summaries"),
        F.max(F.when(kind.isin("compaction_boundary", "compaction_summary"), F.col("msg_idx"))).alias("last"),
    )


def tool_users(events: DataFrame, by: str = "tool", who: str = "session_id") -> DataFrame:
    """(by, agents, used, first, last): how many sessions use each tool, how often, and from when to when.

    Pairs are counted first, so a tool that all sessions use shuffles a row a session and task, not a row a call.
    """
    pairs = events.groupBy(by, who).agg(F.count("*").alias("used"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return pairs.groupBy(by).agg(F.count(who).alias("agents"), F.sum("used").cast("long").alias("used"), F.min("first").alias("first"), F.max("last").alias("last"))


def lowered_values(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, values): the different lower-case values of each group in order; nulls don't count."""
    once = rows.select(by, F.lower(value).alias("_value")).distinct()
    return once.groupBy(by).agg(F.array_sort(F.collect_list("_value")).alias("values"))


def file_totals(events: DataFrame, limit: int | None = None) -> DataFrame:
    """(target, edits, n_reads) over all sessions, the most used first, ties by name."""
    kind = F.col("kind")
    files = events.groupBy("target").agg(F.count_if(kind == "file_edit").alias("edits"), F.count_if(kind == "file_read").alias("n_reads"))
    ordered = files.orderBy((F.col("edits") + F.col("n_reads")).desc(), "target")
    return ordered.limit(limit) if limit is not None else ordered


def projects(rows: DataFrame, by: str, member: str, when: str, tests: dict[str, Column]) -> DataFrame:
    """(by, n, a column for each of ``tests``, first, last): different members of each group, rows that pass each test, first and last instant.

    Members are counted from rows summed by member, so a project that holds a third of all rows isn't one task's work.
    """
    own = rows.groupBy(by, member).agg(*[F.count_if(test).alias(name) for name, test in tests.items()], F.min(when).alias("first"), F.max(when).alias("last"))
    return own.groupBy(by).agg(F.count(member).alias("n"), *[F.sum(name).cast("long").alias(name) for name in tests], F.min("first").alias("first"), F.max("last").alias("last"))


def tallied(rows: DataFrame, distinct: dict[str, str], sums: dict[str, Column], greatest: dict[str, str]) -> DataFrame:
    """One row for many consumers of one pass: n_rows, different values, sums and greatest values, each by its name."""
    return rows.agg(
        F.count("*").alias("n_rows"), *[F.countDistinct(c).alias(n) for n, c in distinct.items()], *[F.sum(c).cast("long").alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in greatest.items()],
    )
