"""Windows over one session's rows in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(by: str, *order: str) -> Window:
    return Window.partitionBy(by).orderBy(*order)


def spans(rows: DataFrame, by: str, order: str, opens: Column) -> DataFrame:
    """``rows`` with ``span``, how many rows that open one stand at or before each."""
    return rows.withColumn("span", F.count_if(opens).over(in_order(by, order)))


def cycles(rows: DataFrame, by: str, order: str, opens: Column, what: str) -> DataFrame:
    """(by, span, first, last, opened_by, closed_by) of each span."""
    held = spans(rows, by, order, opens).groupBy(by, "span")
    return held.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min_by(what, order).alias("opened_by"), F.max_by(what, order).alias("closed_by"))


def changes(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value is known and differs from the last known one before."""
    before = F.last(value, ignorenulls=True).over(in_order(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).where(F.col(value).isNotNull() & ~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def deltas(rows: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.col(value) - F.lag(value).over(in_order(by, *order)))


def top_per_group(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def latest(rows: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """(by, name, revisions): the last value of each group."""
    return rows.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias(name), F.count("*").alias("revisions"))


def calibrated_scale(rows: DataFrame, by: str, order: list[str], used: str, estimated: str, fallback: float | None = None) -> DataFrame:
    """(by, scale): the median ratio of reported to estimated growth over the steps where both grow, or ``fallback`` where none does."""
    steps = deltas(deltas(rows, by, order, used, "_used"), by, order, estimated, "_estimated")
    good = (F.col("_used") > 0) & (F.col("_estimated") > 0)
    found = steps.groupBy(by).agg(F.median(F.when(good, F.col("_used") / F.col("_estimated"))).alias("scale"))
    return found.withColumn("scale", F.coalesce("scale", F.lit(fallback))) if fallback is not None else found.where("scale IS NOT NULL")


def alignment(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two sessions (on, left_role) and (on, right_role) side by side, and whether they agree from the start so far. Two sessions, so one window."""
    both = left.join(right, on, "full")
    same = F.coalesce(F.col("left_role") == F.col("right_role"), F.lit(False))
    return both.withColumn("common", F.bool_and(same).over(Window.orderBy(on)))
