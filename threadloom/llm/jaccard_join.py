"""Operator 8: n-gram Jaccard self-join by rare-first prefix filtering, and its components.

A document's set holds the 64-bit hashes of its distinct word n-grams. Shingles are
ordered by corpus frequency and hash; two sets with Jaccard similarity t or more share
one of their first ``n - ceil(t n) + 1`` shingles. Frequencies are counted over all
documents in 2**22 hash slots, a table of fixed size, so ranking a set needs no join;
any total order gives the same result, slots that two shingles share only cost work.

Equal sets (by 128 bits) are one class. Classes that share a prefix shingle stand in its
bucket. In buckets of up to ``PAIR_BUCKET`` all pairs that pass the length, positional and
suffix filters are candidates. A larger bucket first meets one pivot, its member with the
most common prefix, which is the middle of a group of near copies. Jaccard distance is a
metric, so those at least ``t - (1 - t) / 2`` alike to the pivot can't link to those less
than ``t - 3 (1 - t) / 2`` alike: they leave, and the rest go on with another pivot. What
is left after ``ROUNDS`` pivots, being far from one another, is paired as a small bucket.

Pairs of a pivot's neighbours need a look only if one of them isn't linked to it. With A
and B their symmetric differences to the pivot (sizes n and m, the pivot's C, and q = (1 - t) / (1 + t)),
a link needs ``|A & B| > (|A| + q (C - n)) / 2``. So a rare-first prefix of A of the length
``|A| + 1`` less that bound must meet B. The differences of near copies to their middle are
mostly their own words, hence a group of near copies that don't link brings few pairs
and not their square. No link between components is lost. Each pair is verified once.

Defined results: null and empty texts have an empty set and are alone; texts with fewer
than n words have one shingle, the whole sequence; rows without a doc_id are alone (null
component); rows that share a doc_id are compared like others, each by its own text; an
empty table gives no rows; other columns are ignored. Word length and text length are unlimited.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.arrays import Texts, mix, windows
from threadloom.llm.batches import only, slices
from threadloom.llm.components import components
from threadloom.llm.marks import marks, slot, with_mark
from threadloom.session import written

SLOT_BITS, BLOCK = 22, 1 << 16
PAIR_BUCKET, ROUNDS, RANGES = 16, 3, 8


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of one batch."""
    texts = Texts(column, lower_ascii=True)
    words, rows = texts.word_hashes(), texts.word_rows()
    grams, at = windows(words, rows, size)
    cut = np.searchsorted(rows[at], np.arange(texts.n + 1))
    out = []
    for i in range(texts.n):
        own = grams[cut[i] : cut[i + 1]]
        if not len(own):
            few = words[texts.word_at[i] : texts.word_at[i + 1]]
            if len(few):  # a tag of its own length keeps it apart from full shingles
                total = np.uint64(len(few))
                for h in few:
                    total = mix(np.array([total ^ h]))[0]
                own = np.array([total], np.uint64)
        out.append(np.unique(own))
    return out


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Documents' shingles in each hash slot: 2**22 counts, whatever the corpus.

    Each task sends its counts as compressed blocks; they are added in two steps over
    the square root of the tasks each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only("shingles")
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                np.add.at(total, slots(np.concatenate(sets)), 1)
        if total.any():
            blocks = total.reshape(-1, BLOCK)
            yield pa.record_batch({
                "block": pa.array(range(len(blocks)), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int32()),
                "counts": pa.array([zlib.compress(b.astype(np.int64).tobytes(), 1) for b in blocks]),
            })

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for one in table.column("counts"):
            total += np.frombuffer(zlib.decompress(one.as_py()), np.int64)
        return table.slice(0, 1).select(["block", "task"]).append_column("counts", pa.array([zlib.compress(total.tobytes(), 1)]))

    schema = "block int, task int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    step = max(1, round(docs.rdd.getNumPartitions() ** 0.5))
    parts = parts.withColumn("task", F.pmod("task", F.lit(step))).groupBy("block", "task").applyInArrow(add, schema)
    rows = parts.groupBy("block").applyInArrow(add, schema).toArrow().to_pylist()
    total = np.zeros((1 << SLOT_BITS) // BLOCK * BLOCK, np.int64).reshape(-1, BLOCK)
    for r in rows:
        total[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return total.reshape(-1)


def fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, f1, f2, ranges, common, prefix): set size, fingerprint, counts by hash range, how common the prefix is, rarest shingles first."""
    counts = slot_counts(docs, size)
    level = np.minimum(255, np.floor(8 * np.log2(counts + 1.0))).astype(np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(level)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("shingles")
        rank = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                head = [s[np.argsort(rank[slots(s)], kind="stable")[: prefix_length(len(s), percent)]] if len(s) else s for s in sets]
                prints = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([p[0] for p in prints], np.uint64).view(np.int64)), pa.array(np.array([p[1] for p in prints], np.uint64).view(np.int64)),
                        pa.array([np.bincount((s >> np.uint64(61)).astype(np.int64), minlength=RANGES).astype(np.int32) for s in sets], pa.list_(pa.int32())),
                        pa.array([float(rank[slots(h)].mean()) if len(h) else 0.0 for h in head], pa.float32()), pa.array([h.view(np.int64) for h in head], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "f1", "f2", "ranges", "common", "prefix"],
                )

    schema = f"doc_id {id_type}, n long, f1 long, f2 long, ranges array<int>, common float, prefix array<long>"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def sets_of(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(k, shingles) of the classes ``needed`` (k, doc)."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                key = np.array([fingerprint(s)[0] for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k", "shingles"])

    named = docs.where("doc_id IS NOT NULL").withColumn("_slot", slot(F.col("doc_id")))
    found = with_mark(named, marks(needed.select(slot(F.col("doc")).alias("_slot")))).where("_mark").select("text")
    sets = found.mapInArrow(get, "k long, shingles array<long>")
    return sets.join(needed.select("k"), "k", "left_semi").dropDuplicates(["k"])


class Join:
    """The stages of one self-join; ``k`` names a class."""

    def __init__(self, meta: DataFrame, percent: int):
        #: (k, n, ranges) of all classes; (k, shingles) of those that may be compared
        self.meta, self.percent = meta, percent
        self.sets: DataFrame | None = None

    def overlap(self, n: Column, m: Column) -> Column:
        """Least common shingles of linked sets of n and m: ceil(p (n + m) / (100 + p))."""
        return F.ceil(self.percent * (n + m) / (100 + self.percent) - 1e-9)

    def near_sizes(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def bucket_pairs(self, rows: DataFrame) -> DataFrame:
        """Distinct (a, b), a < b, of ``rows`` (shingle, k, n, pos) that share a shingle and pass the filters."""
        x, y = rows.alias("x"), rows.where("k IS NOT NULL").alias("y")
        n, m = F.col("x.n"), F.col("y.n")
        positional = 1 + F.least(n - F.col("x.pos"), m - F.col("y.pos")) >= self.overlap(n, m)
        pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.k") < F.col("y.k")) & self.near_sizes(n, m) & positional)
        return self.suffix_filtered(pairs.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct())

    def suffix_filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose counts by hash range leave room for the overlap that a link needs."""
        a = self.meta.select(F.col("k").alias("a"), F.col("n").alias("n_a"), F.col("ranges").alias("r_a"))
        b = self.meta.select(F.col("k").alias("b"), F.col("n").alias("n_b"), F.col("ranges").alias("r_b"))
        apart = F.aggregate(F.zip_with("r_a", "r_b", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, d: s + d)
        room = F.col("n_a") + F.col("n_b") - 2 * self.overlap(F.col("n_a"), F.col("n_b"))
        return pairs.join(a, "a").join(b, "b").where(apart <= room).select("a", "b")

    def with_sets(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with the shingles of both; only sets in a slot of a pair are shuffled."""
        keyed, out = self.sets.withColumn("_slot", slot(F.col("k"))), pairs
        for side in ("a", "b"):
            near = with_mark(keyed, marks(pairs.select(slot(F.col(side)).alias("_slot")))).where("_mark")
            out = out.join(near.select(F.col("k").alias(side), F.col("shingles").alias(f"of_{side}")), side)
        return out

    def linked(self, common: Column, sizes: Column) -> Column:
        return 100 * common >= self.percent * (sizes - common)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that link."""
        common = F.size(F.array_intersect("of_a", "of_b"))
        both = self.with_sets(pairs).select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
        return both.where(self.linked(F.col("common"), F.col("sizes"))).select("a", "b")

    def stars(self, pairs: DataFrame, near: float) -> DataFrame:
        """(k, pivot, n, pivot_n, alike, linked, rest) of ``pairs``; ``rest`` is the symmetric difference, null under ``near``."""
        own, others = F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a")
        both = self.with_sets(pairs.select(F.col("k").alias("a"), F.col("pivot").alias("b")))
        both = both.select("a", "b", F.size("of_a").alias("n"), F.size("of_b").alias("pivot_n"), own.alias("own"), others.alias("others"))
        common, sizes = F.col("n") - F.size("own"), F.col("n") + F.col("pivot_n")
        alike = common / (sizes - common)
        return both.select(
            F.col("a").alias("k"), F.col("b").alias("pivot"), "n", "pivot_n", alike.alias("alike"), self.linked(common, sizes).alias("linked"),
            F.when(alike >= near, F.concat("own", "others")).alias("rest"),
        )

    def between(self, star: DataFrame) -> DataFrame:
        """Candidate pairs of neighbours of one pivot, of which one isn't linked to it."""
        group = star.where("rest IS NOT NULL")
        loose = group.where("NOT linked").select("pivot").distinct()
        q = (100 - self.percent) / (100 + self.percent)
        bound = (F.size("rest") + q * (F.col("pivot_n") - F.col("n"))) / 2
        shared = F.greatest(F.lit(1), F.floor(bound - 1e-9) + 1)
        rows = group.join(loose, "pivot", "left_semi").select(
            "pivot", "k", "n", "linked", F.size("rest").alias("size"), (F.size("rest") - shared + 1).alias("head"), F.explode("rest").alias("element")
        )
        held = rows.groupBy("pivot", "element").agg(F.count("*").alias("held"))
        place = F.row_number().over(Window.partitionBy("pivot", "k").orderBy("held", "element"))
        rows = written(rows.join(held, ["pivot", "element"]).withColumn("place", place).where("held > 1"), "between")
        x, y = rows.where("place <= head").alias("x"), rows.where("NOT linked").alias("y")
        same = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.k") != F.col("y.k"))
        # the first common element must leave room for all that a link needs
        apart = F.col("x.n") + F.col("y.n") - 2 * self.overlap(F.col("x.n"), F.col("y.n"))
        room = 2 * (1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))) >= F.col("x.size") + F.col("y.size") - apart
        pairs = x.join(y, same & room & self.near_sizes(F.col("x.n"), F.col("y.n")))
        return pairs.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).distinct()

    def rounds(self, active: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
        """Links, candidate pairs and checked pairs of the large buckets ``active`` (shingle, k, n, common, pos, held)."""
        found, waiting, done = [], [], []
        t = self.percent / 100
        leave, near = t - (1 - t) / 2, t - 3 * (1 - t) / 2
        for _ in range(ROUNDS):
            if active.isEmpty():
                return found, waiting, done
            pivots = active.groupBy("shingle").agg(F.max(F.struct("common", F.xxhash64("k").alias("h"), "k", "n")).alias("p"))
            pivots = pivots.select("shingle", F.col("p.k").alias("pivot"), F.col("p.n").alias("pivot_n"))
            seated = written(active.drop("held").join(pivots, "shingle").where("k <> pivot"), "seated")
            close = F.least("n", "pivot_n") >= (near - 1e-9) * F.greatest("n", "pivot_n")
            met = written(seated.where(close).select("k", "pivot").distinct(), "met")
            star = written(self.stars(met, near - 1e-9), "stars")
            found.append(star.where("linked").select(F.col("k").alias("a"), F.col("pivot").alias("b")))
            done.append(star.select(F.least("k", "pivot").alias("a"), F.greatest("k", "pivot").alias("b")))
            waiting.append(self.between(star))
            gone = star.where(F.col("alike") >= leave).select("k", "pivot")
            rest = seated.join(gone, ["k", "pivot"], "left_anti").drop("pivot", "pivot_n")
            held = rest.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
            active = written(rest.join(held, "shingle"), "active")
            waiting.append(self.bucket_pairs(active.where(F.col("held") <= PAIR_BUCKET)))
            active = active.where(F.col("held") > PAIR_BUCKET)
        waiting.append(self.bucket_pairs(active))
        return found, waiting, done


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    cut = written(prefixes(docs, size, percent), "prefixes")
    real = cut.where("n > 0 AND doc_id IS NOT NULL")
    first = [F.first(c).alias(c) for c in ("n", "ranges", "common", "prefix")]
    classes = written(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), *first).withColumn("k", F.col("f1")), "classes")
    exploded = classes.select("k", "n", "common", F.posexplode("prefix").alias("pos", "shingle")).withColumn("pos", F.col("pos") + 1)
    held = exploded.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    active = written(exploded.join(held, "shingle"), "active")
    join = Join(classes.select("k", "n", "ranges"), percent)
    small, large = active.where(F.col("held") <= PAIR_BUCKET), active.where(F.col("held") > PAIR_BUCKET)
    pairs = written(join.bucket_pairs(small), "pairs")
    needed = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).union(large.select("k")).distinct()
    needed = written(classes.select("k", "doc").join(needed, "k"), "needed")
    join.sets = written(sets_of(docs, needed, size), "sets")
    found, waiting, done = join.rounds(large)
    rest = union([pairs, *waiting]).distinct()
    if done:
        rest = rest.join(union(done).distinct(), ["a", "b"], "left_anti")
    links = written(union([*found, join.links(written(rest, "rest"))]), "links")
    label = components(links).select(F.col("id").alias("k"), "component")
    linked = written(classes.select("f1", "f2", "k", "doc").join(label, "k"), "linked")
    least = linked.groupBy("component").agg(F.min("doc").alias("least"))
    named = linked.join(least, "component").select("f1", "f2", "least")
    named = classes.select("f1", "f2", "doc").join(named, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("least", "doc").alias("class"))
    return cut.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class")).otherwise(F.col("doc_id")).alias("component_id"),
    )


#: DuckDB SQL for the rows of ``jaccard_join`` on documents, by all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id
FROM sets s LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = s.doc_id
"""
