"""Operator 4: mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (the MD5 of its doc_id and a seed). Within a
source the documents stand in key order; the mix takes whole epochs of the source
while its budget lasts and then the documents up to the key at which the running
sum of sizes reaches the rest, so that a source's taken words equal its target
rounded down. The running sums are distributed: sizes are summed by key prefix
(two hexadecimal digits a level), the prefix that holds the cut is found among at
most 256 sums, and only its documents go to the next level. No window holds more
than 256 rows of a source, however hot, until the last one, whose rows share six digits.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share
``share`` times all words; a source stops at ``max_epochs`` times its own words and
the excess goes to the others by weight until none is above.

Defined results: null text has size 0 and null source is a source of its own;
documents of size 0 take 0 words; repeated rows with one doc_id share a key and, at
the cut, split the rest in proportion to their sizes (rounded down); an empty table
gives no rows; input columns with output names are replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import written

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = (2, 4, 6, 32)
OUTPUTS = ("size", "source_size", "target", "taken", "copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, source_size): one row for each source.

    Sources fill up in the order of cap over weight, so the first that its share
    doesn't fill fixes the level for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0.0)
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("place", F.row_number().over(by_level))
        .withColumn("rest", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("others", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("open", F.col("cap") > F.col("weight") * F.col("rest") / F.col("others"))
    )
    level = F.min(F.when(F.col("open"), F.struct("place", "rest", "others"))).over(every)
    shared = F.col("weight") * F.col("level.rest") / F.col("level.others")
    return filled.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), F.col("cap")).otherwise(shared).alias("target"),
    )


def source_cuts(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source the epochs, the cut key, the words due from the documents with that key, and their size."""
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("due", whole - F.col("epochs") * F.col("source_size"))
    plan = written(plan, "plan")
    open_ = plan.select("source", F.lit("").alias("head"), "due").where("due > 0")
    for digits in DIGITS:
        at = open_.select(F.col("source").alias("s"), F.col("head").alias("h"), F.col("due").alias("d"))
        head = F.substring("key", 1, digits)
        inside = slim.join(at, F.col("source").eqNullSafe(F.col("s")) & F.col("key").startswith(F.col("h")))
        sums = inside.groupBy("source", "d", head.alias("head")).agg(F.sum("size").alias("own"))
        upto = F.sum("own").over(Window.partitionBy("source").orderBy("head"))
        open_ = written(
            sums.withColumn("before", upto - F.col("own"))
            .where((F.col("before") < F.col("d")) & (F.col("d") <= F.col("before") + F.col("own")))
            .select("source", "head", (F.col("d") - F.col("before")).alias("due"), "own"),
            "cut",
        )
    cuts = open_.select(F.col("source").alias("s"), F.col("head").alias("cut"), F.col("due").alias("part"), "own")
    return plan.join(cuts, plan["source"].eqNullSafe(cuts["s"]), "left").select(
        F.col("source").alias("_of"), "source_size", "target", F.col("epochs").alias("_epochs"), F.coalesce("cut", F.lit("")).alias("_cut"),
        F.col("part").alias("_part"), F.col("own").alias("_own"),
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: str = "mix"
) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) with size, source_size, target, taken words and whole ``copies``.

    ``copies`` is the count of whole documents that the mix emits: the epochs, one
    more before the cut, and at the cut one more if at least half of its words are due.
    """
    docs = docs.drop(*OUTPUTS)
    slim = written(docs.select("source", random_key(seed).alias("key"), n_words(F.col("text")).alias("size")), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = written(source_cuts(slim, source_targets(sizes, weights, share, max_epochs)), "cuts")
    key, size = F.col("_key"), F.col("size")
    part = F.floor(size * F.col("_part") / F.col("_own")).cast("long")
    more = F.when(key < F.col("_cut"), size).when(key == F.col("_cut"), part).otherwise(F.lit(0))
    once = F.when(key < F.col("_cut"), 1).when((key == F.col("_cut")) & (2 * part >= size), 1).otherwise(F.lit(0))
    joined = docs.withColumn("size", n_words(F.col("text"))).withColumn("_key", random_key(seed))
    return joined.join(cuts, joined["source"].eqNullSafe(cuts["_of"]), "left").select(
        *docs.columns, "size", "source_size", "target",
        (F.col("_epochs") * size + more).cast("long").alias("taken"),
        (F.col("_epochs") + once).cast("int").alias("copies"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM docs GROUP BY source
), capped AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM named
), levels AS (
  SELECT *, row_number() OVER o AS place,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS others
  FROM capped WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), first_open AS (
  SELECT place AS open_place, rest AS open_rest, others AS open_others
  FROM levels WHERE cap > weight * rest / others ORDER BY place LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN open_place IS NULL OR place < open_place THEN cap ELSE weight * open_rest / open_others END AS target
  FROM levels LEFT JOIN first_open ON true
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets
), run AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size AS due,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS BIGINT) AS upto
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, epochs * size + least(size, greatest(0, due - (upto - size))) AS taken FROM run
"""
