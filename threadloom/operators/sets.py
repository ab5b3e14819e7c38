"""Tables against tables: shadowing, postings algebra, duplicates, vanished and redelivered rows, winning revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shadowed(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of each key in ``fresh`` replaced by those of ``fresh``: live over index, a batch over its table."""
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def matching(all_of: list[DataFrame], none_of: list[DataFrame], key: str) -> DataFrame:
    """Keys that are in every one of ``all_of`` and in none of ``none_of``."""
    out = all_of[0].select(key).distinct()
    for other in all_of[1:]:
        out = out.join(other.select(key), key, "left_semi")
    for other in none_of:
        out = out.join(other.select(key), key, "left_anti")
    return out


def first_seen(rows: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """(by, seen): the different values of each group in the order in which they first came."""
    once = rows.groupBy(by, value).agg(F.min(F.struct(*order)).alias("_at"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", value)))
    return once.groupBy(by).agg(F.transform(ordered, lambda x: x[value]).alias("seen"))


def best_of_duplicates(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Of rows with one key the first by ``order``; rows without a key all stay."""
    held = rows.withColumn("_key", key)
    at = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    once = held.where("_key IS NOT NULL").withColumn("_at", at).where("_at = 1").drop("_at")
    return once.unionByName(held.where("_key IS NULL")).drop("_key")


def missing(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``held`` doesn't have; rows without a key too."""
    return rows.join(held.select(key), key, "left_anti")


def vanished(known: DataFrame, found: DataFrame, key: str, complete: Column | None = None) -> DataFrame:
    """Known rows that an inventory found no more. A part of the inventory that failed (``complete`` false) takes nothing away."""
    gone = missing(known, found, key)
    return gone.where(F.coalesce(complete, F.lit(False))) if complete is not None else gone


def redelivered(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n, conflict): deliveries of each key, and whether their contents differ."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.countDistinct(content) > 1).alias("conflict"))


def winning_revisions(rows: DataFrame, key: str, order: list[str], ts: Column, gone: Column) -> DataFrame:
    """Of each key the revision with the greatest (effective time, order); a winning removal takes the key away.

    A revision without a time takes the greatest time of the revisions before it in ``order``.
    """
    own = Window.partitionBy(key)
    held = rows.withColumn("_ts", ts)
    so_far = F.max("_ts").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_at", F.coalesce("_ts", so_far, F.lit(-1)))
    place = F.row_number().over(own.orderBy(*[F.col(c).desc() for c in ("_at", *order)]))
    return held.withColumn("_place", place).where((F.col("_place") == 1) & ~F.coalesce(gone, F.lit(False))).drop("_ts", "_at", "_place")


def quiet(rows: DataFrame, key: str, when: str, seconds: int) -> DataFrame:
    """(key, last) of the keys without a row in the last ``seconds`` before the newest of all."""
    last = rows.groupBy(key).agg(F.max(when).alias("last"))
    now = last.agg(F.max("last").alias("_now"))
    return last.join(F.broadcast(now)).where(F.col("last") <= F.col("_now") - F.make_dt_interval(secs=F.lit(seconds))).drop("_now")


def inbox(rows: DataFrame, reasons: list[tuple[str, Column]], order: list[str], limit: int) -> DataFrame:
    """Rows with the first of ``reasons`` that holds, the more urgent reasons first, then by ``order``."""
    reason, rank = F.lit(None).cast("string"), F.lit(len(reasons))
    for k, (name, test) in reversed(list(enumerate(reasons))):
        reason, rank = F.when(test, name).otherwise(reason), F.when(test, k).otherwise(rank)
    return rows.withColumn("reason", reason).withColumn("_rank", rank).where("reason IS NOT NULL").orderBy("_rank", *order).limit(limit).drop("_rank")


def answered(calls: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Calls with their results; a call without one drops out."""
    return calls.join(results, on)


def unanswered(calls: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    return calls.join(results.select(*on), on, "left_anti")


def united(*tables: DataFrame) -> DataFrame:
    """The different rows of all tables."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out.distinct()


def different(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The different values of ``columns``; the shuffle spills, so memory doesn't bound it."""
    return rows.select(*columns).distinct()


def denormalized(facts: DataFrame, required: list[tuple[DataFrame, Column]], optional: list[tuple[DataFrame, Column]]) -> DataFrame:
    """``facts`` with the tables that each row needs, then with those that it may lack."""
    for table, on in required:
        facts = facts.join(table, on)
    for table, on in optional:
        facts = facts.join(table, on, "left")
    return facts
