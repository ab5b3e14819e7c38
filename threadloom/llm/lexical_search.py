"""Operator 11: ranked lexical search on document-sharded postings with integer impacts.

``build`` counts the corpus (documents with a term, terms in all) in one pass and writes the
index in a second one, with no shuffle: each task turns its texts, about ``SHARD_BYTES`` at a time,
into a shard, a CSR matrix of terms by documents with the impact of each posting already
computed as a 32-bit integer. ``search`` takes the items in passes of about ``TERMS_IN_PASS``
different terms, the only thing that is broadcast. A pass looks up how many documents hold each
of its terms (reading the shards' term lists alone), then every task scores its shards term
at a time in a dense accumulator, keeps each item's k best with all ties decided by id, and
merges its shards before it emits anything; a window over items merges the tasks.

Terms are 64-bit hashes of their bytes. All of a score but the term weight's logarithm is
integer arithmetic. Defined results: null, empty and term-less texts are no documents and are
never found; rows with a null doc_id or item_id take no part; rows that repeat a doc_id are
documents of their own; the different texts of one item_id are one item, terms added; equal
scores rank by ascending doc_id; a text longer than a block is cut between terms; an empty
table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.arrays import Texts, buffers
from threadloom.llm.batches import slices
from threadloom.session import written

SHARD_BYTES, BLOCK_BYTES, TERMS_IN_PASS = 1 << 21, 1 << 19, 1 << 19
SHARD = "doc_ids binary, terms binary, starts binary, docs binary, impacts binary"

#: what each byte becomes: a space between terms, A-Z in lower case, other bytes of terms themselves
_TERM = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_low : _high + 1] = np.arange(_low, _high + 1, dtype=np.uint8)
_TERM[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class Index:
    """``shards`` (SHARD), written; ``documents`` with a term and their ``terms``, repeats counted."""

    shards: DataFrame
    documents: int
    terms: int


def term_counts(column: pa.Array) -> np.ndarray:
    """Terms of each row, repeats counted."""
    raw, at = buffers(column)
    inside = _TERM[raw] != 0x20
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    first[heads] = inside[heads]
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(first, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def term_hashes(column: pa.Array, block: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term in ``column``. Works on about ``block`` bytes at a time, cut between terms."""
    raw, at = buffers(column)
    raw = _TERM[raw]
    cuts = [at]
    for i in np.flatnonzero(np.diff(at) > block):
        gaps = at[i] + np.flatnonzero(raw[at[i] : at[i + 1]] == 0x20)
        wanted = np.searchsorted(gaps, np.arange(at[i] + block, at[i + 1], block))
        cuts.append(gaps[wanted[wanted < len(gaps)]])
    bounds = np.unique(np.concatenate(cuts))
    row = np.searchsorted(at, bounds[:-1], "right") - 1
    groups = (bounds[1:] // block).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(row)]
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            piece = np.ascontiguousarray(raw[bounds[a] : bounds[b]])
            offsets = bounds[a : b + 1] - bounds[a]
            texts = Texts(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(piece)))
            rows.append(row[a:b][texts.word_rows()])
            hashes.append(texts.word_hashes())
    return np.concatenate(rows), np.concatenate(hashes)


def impact(times: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Saturated and length-normalised weight of ``times`` occurrences in a document of ``lengths`` terms."""
    damp = 100 - 75 + (75 * lengths * documents) // max(terms, 1)
    return (1_000_000_000 * times) // (1000 * times + 8 * damp)


def shard(ids: np.ndarray, column: pa.Array, documents: int, terms: int) -> dict[str, np.ndarray]:
    """The CSR postings of one slice of texts: those of term i are docs[starts[i]:starts[i + 1]], ascending."""
    rows, hashes = term_hashes(column)
    lengths = np.bincount(rows, minlength=len(ids)).astype(np.int64)
    order = np.lexsort((rows, hashes))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(rows)))
    docs, hashes = rows[at], hashes[at]
    head = np.ones(len(docs), bool)
    head[1:] = hashes[1:] != hashes[:-1]
    starts = np.append(np.flatnonzero(head), len(docs))
    return {
        "doc_ids": ids.astype(np.int64), "terms": hashes[head], "starts": starts.astype(np.int64), "docs": docs.astype(np.int32),
        "impacts": impact(times, lengths[docs], documents, terms).astype(np.int32),
    }


def build(docs: DataFrame) -> Index:
    """The index of all rows of ``docs`` (doc_id, text)."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                n = term_counts(part.column("text"))
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        yield pa.record_batch({"documents": pa.array([documents], pa.int64()), "terms": pa.array([terms], pa.int64())})

    found = docs.select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = found[0] or 0, found[1] or 0

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                made = shard(part.column("doc_id").to_numpy(zero_copy_only=False), part.column("text"), documents, terms)
                yield pa.record_batch({k: pa.array([v.tobytes()], pa.binary()) for k, v in made.items()})

    return Index(written(docs.mapInArrow(shards, SHARD), "postings"), documents, terms)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of ``items`` (item_id, text)."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, hashes = term_hashes(part.column("text"))
                yield pa.record_batch({"item_id": part.column("item_id").take(pa.array(rows)), "term": pa.array(hashes.view(np.int64))})

    kept = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    return kept.mapInArrow(terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def best(acc: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest positive sums in ``acc``; of equal ones at the border those of the smallest ids."""
    hit = np.flatnonzero(acc)
    if len(hit) <= k:
        return hit
    sums = acc[hit]
    border = sums[np.argpartition(sums, len(sums) - k)[len(sums) - k :]].min()
    above, level = hit[sums > border], hit[sums == border]
    return np.concatenate([above, level[np.argsort(ids[level], kind="stable")[: k - len(above)]]])


def merged(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each item by descending score and ascending doc."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item) < k
    return item[keep], doc[keep], score[keep]


class Pass:
    """The distinct terms of some items, and each item's terms as places among them."""

    def __init__(self, rows: pa.Table):
        term = rows.column("term").to_numpy().view(np.uint64)
        item = rows.column("item_id").to_numpy()
        order = np.argsort(item, kind="stable")
        self.terms, place = np.unique(term, return_inverse=True)
        self.place, self.times = place[order], rows.column("times").to_numpy()[order]
        self.items, starts = np.unique(item[order], return_index=True)
        self.starts = np.append(starts, len(item))
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, held: pa.Table, documents: int) -> None:
        """Weights from ``held`` (term, df): in how many of all ``documents`` each term is."""
        df = np.zeros(len(self.terms), np.int64)
        df[np.searchsorted(self.terms, held.column("term").to_numpy().view(np.uint64))] = held.column("df").to_numpy()
        self.weights = np.where(df > 0, np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))), 0).astype(np.int64)

    def spans(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of each term start and end in a shard; alike where it lacks them."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(len(terms) - 1, 0))
        there = terms[at] == self.terms if len(terms) else np.zeros(len(self.terms), bool)
        return np.where(there, starts[at], 0), np.where(there, starts[at + 1], 0) if len(terms) else np.zeros(len(self.terms), np.int64)

    def scored(self, row: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, doc_id and score of each item's ``k`` best documents in one shard."""
        ids, docs, impacts = row["doc_ids"], row["docs"], row["impacts"].astype(np.int64)
        low, high = self.spans(row["terms"], row["starts"])
        use = (high > low) & (self.weights > 0)
        out = [(np.zeros(0, np.int64),) * 3]
        for i in range(len(self.items)):
            own = slice(self.starts[i], self.starts[i + 1])
            acc = np.zeros(len(ids), np.int64)
            for p, times in zip(self.place[own].tolist(), self.times[own].tolist()):
                if use[p]:
                    a, b = low[p], high[p]
                    acc[docs[a:b]] += self.weights[p] * times * impacts[a:b]  # a term names a document once
            at = best(acc, ids, k)
            out.append((np.full(len(at), self.items[i]), ids[at], acc[at]))
        return tuple(np.concatenate(c) for c in zip(*out))


def rows_of(batch: pa.RecordBatch, columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    kind = {"terms": np.uint64, "docs": np.int32, "impacts": np.int32}
    for i in range(batch.num_rows):
        yield {c: np.frombuffer(batch.column(c)[i].as_buffer(), kind.get(c, np.int64)) for c in columns}


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each of ``items`` (item_id, text), scores above 0."""
    spark = items.sparkSession
    asked = written(item_terms(items), "asked")
    passes = max(1, -(-asked.count() // TERMS_IN_PASS))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for p in range(passes):
        now = Pass(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toArrow())
        if not len(now.items) or not index.documents:
            continue
        plain = spark.sparkContext.broadcast(now)

        def holds(batches: Iterator[pa.RecordBatch], plain=plain) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(plain.value.terms), np.int64)
            for batch in batches:
                for row in rows_of(batch, ["terms", "starts"]):
                    low, high = plain.value.spans(row["terms"], row["starts"])
                    df += high - low
            at = np.flatnonzero(df)
            yield pa.record_batch({"term": pa.array(plain.value.terms[at].view(np.int64)), "df": pa.array(df[at])})

        held = index.shards.select("terms", "starts").mapInArrow(holds, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        now.weigh(held.toArrow(), index.documents)
        weighed = spark.sparkContext.broadcast(now)

        def scores(batches: Iterator[pa.RecordBatch], weighed=weighed) -> Iterator[pa.RecordBatch]:
            kept = (np.zeros(0, np.int64),) * 3
            for batch in batches:
                for row in rows_of(batch, ["doc_ids", "terms", "starts", "docs", "impacts"]):
                    more = weighed.value.scored(row, k)
                    kept = merged(*(np.concatenate(c) for c in zip(kept, more)), k)
            yield pa.record_batch(dict(zip(["item_id", "doc_id", "score"], map(pa.array, kept))))

        found = found.unionAll(index.shards.mapInArrow(scores, "item_id long, doc_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS place, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS words FROM docs),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE item_id IS NOT NULL AND text IS NOT NULL)
  GROUP BY 1, 2
),
postings AS (
  SELECT place, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT place, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3, 4
),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY 1),
scores AS (
  SELECT item_id, place, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // words))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), corpus GROUP BY 1, 2, 3
),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
