"""Walks over parent links, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import written


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of all that hang below each root (edges: parent, child); the first visit counts, so cycles end.

    One step for each level; where every child has one parent, ``depths`` takes the logarithm of them.
    """
    seen = written(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")), "walk")
    step, depth = seen, 0
    while True:
        depth += 1
        below = step.join(edges, F.col("id") == F.col("parent")).select("root", F.col("child").alias("id")).distinct()
        step = written(below.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)), "walk")
        if step.isEmpty():
            return seen
        seen = seen.unionByName(step)


def jumps(links: DataFrame) -> list[DataFrame]:
    """(id, up) tables of ``links`` (id, up): one step up, two, four and so on, until none is left or a cycle must have closed."""
    tables = [written(links.where("up IS NOT NULL").select("id", "up"), "jumps")]
    most = tables[0].count()
    while 1 << len(tables) <= 2 * most:
        last = tables[-1]
        twice = written(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up")), "jumps")
        if twice.isEmpty():
            break
        tables.append(twice)
    return tables


def depths(nodes: DataFrame) -> DataFrame:
    """(id, root, depth) of ``nodes`` (id, parent_id), in as many steps as the logarithm of the deepest.

    A node whose parent is null or absent is a root; nodes on or below a cycle have null root and depth.
    """
    known = nodes.select(F.col("id").alias("parent_id")).distinct()
    links = nodes.where("parent_id IS NOT NULL").join(known, "parent_id", "left_semi").select("id", F.col("parent_id").alias("up"))
    found = nodes.select("id", F.col("id").alias("at"), F.lit(0).cast("long").alias("depth"))
    tables = jumps(links)
    for k in reversed(range(len(tables))):  # the largest jumps first: each is taken at most once
        step = tables[k].select(F.col("id").alias("at"), "up")
        moved = found.join(step, "at", "left")
        found = moved.select("id", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
    found = written(found, "depths")
    loose = found.join(links.select(F.col("id").alias("at")), "at", "left_semi").select("id")
    rooted = found.join(loose, "id", "left_anti").select("id", F.col("at").alias("root"), "depth")
    none = loose.withColumn("root", F.lit(None).cast(nodes.schema["id"].dataType)).withColumn("depth", F.lit(None).cast("long"))
    return rooted.unionByName(none)


def ways_up(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): every node on the way up from each of ``starts`` (id), itself included; cycles end."""
    found = starts.select(F.col("id").alias("start"), "id")
    for table in reversed(jumps(links)):
        found = written(found.unionByName(found.join(table, "id").select("start", F.col("up").alias("id"))).distinct(), "ways")
    return found


def paired_boundaries(rows: DataFrame) -> DataFrame:
    """(session_id, summary, boundary): each summary's boundary by parent id, else the latest one before it that no parent id names."""
    from pyspark.sql import Window

    summaries = rows.where("kind = 'compaction_summary'")
    boundaries = rows.where("kind = 'compaction_boundary'").select("session_id", F.col("id").alias("boundary"), F.col("msg_idx").alias("at"))
    named = summaries.join(boundaries, (summaries["session_id"] == boundaries["session_id"]) & (F.col("parent_id") == F.col("boundary"))).select(summaries["session_id"], F.col("id").alias("summary"), "boundary")
    free = boundaries.join(named.select("session_id", "boundary"), ["session_id", "boundary"], "left_anti")
    left = summaries.join(named.select("session_id", F.col("summary").alias("id")), ["session_id", "id"], "left_anti")
    both = left.select("session_id", F.col("msg_idx").alias("at"), F.col("id").alias("summary"), F.lit(None).cast("string").alias("boundary")).unionByName(free.withColumn("summary", F.lit(None).cast("string")))
    last = F.last("boundary", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("at"))
    later = both.withColumn("found", last).where("summary IS NOT NULL AND found IS NOT NULL").select("session_id", "summary", F.col("found").alias("boundary"))
    return named.unionByName(later)
