"""Full-text, exact and fused search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import terms


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl) of ``docs`` (doc_id, text): the index that many queries share."""
    words = terms(F.coalesce("text", F.lit("")))
    held = docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return held.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def uses(lower: Column, term: str) -> Column:
    """How often a lower-case text holds a term of letters and digits; matched in place, no array of words is made."""
    return F.regexp_count(lower, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 score of every row of ``docs`` (doc_id, text) that holds all query terms.

    Only the query's terms are counted, inside the scan; the corpus statistics are
    one aggregate row, so ranking shuffles nothing but that row.
    """
    lower = F.lower(F.coalesce("text", F.lit("")))
    held = docs.select("doc_id", F.regexp_count(lower, F.lit("[a-z0-9]+")).alias("dl"), *[uses(lower, q).alias(f"tf{k}") for k, q in enumerate(query)])
    stats = held.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"),
        *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(query))],
    )
    score = F.lit(0.0)
    for k in range(len(query)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    for k in range(len(query)):
        held = held.where(F.col(f"tf{k}") > 0)
    return held.join(F.broadcast(stats)).select("doc_id", score.alias("score"))


def exact(docs: DataFrame, literal: str, case_sensitive: bool = False) -> DataFrame:
    """Rows whose text holds the literal; an empty literal finds none."""
    if not literal:
        return docs.where(F.lit(False))
    if case_sensitive:
        return docs.where(F.contains("text", F.lit(literal)))
    return docs.where(F.contains(F.lower("text"), F.lit(literal.lower())))


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """Rows that hold the words one after another."""
    return docs.where(F.lower("text").rlike(f"(?<![a-z0-9]){'[^a-z0-9]+'.join(words)}(?![a-z0-9])"))


def batch(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, doc_id) of each of ``queries`` (item_id, text) and each of ``docs`` (doc_id, text) that holds all its words.

    A query meets only the documents with its rarest word, and these are then tested for the others.
    """
    held = docs.select("doc_id", F.array_distinct(terms(F.coalesce("text", F.lit("")))).alias("words"))
    wanted = queries.select("item_id", F.array_distinct(terms(F.coalesce("text", F.lit("")))).alias("wanted"))
    asked = wanted.select("item_id", F.explode("wanted").alias("word"))
    terms_asked = asked.select("word").distinct()
    df = held.select(F.explode("words").alias("word")).join(terms_asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    # a word that no document has leaves its query without a hit
    rarest = asked.join(df, "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    # words meet queries as single words; a document's array joins once for each of its candidates, not for each of its words
    pairs = held.select("doc_id", F.explode("words").alias("word")).join(rarest, "word").select("item_id", "doc_id")
    return pairs.join(held, "doc_id").join(wanted, "item_id").where(F.size(F.array_except("wanted", "words")) == 0).select("item_id", "doc_id")


def best_of_session(hits: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best sessions by their best chunk, ties by id."""
    return hits.groupBy("session_id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "session_id").limit(limit)


def fuse(channels: list[tuple[DataFrame, float]], limit: int, offset: float = 60.0) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists (id, score): each id adds weight / (offset + rank), ranks from 0.

    The windows rank hit lists, which search limits bound.
    """
    parts = None
    for hits, weight in channels:
        once = hits.groupBy("id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "id")) - 1
        one = once.select("id", (weight / (offset + rank)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)



# Words that a relaxed query leaves out.
STOPWORDS = ["the", "and", "for", "that", "with", "this", "from", "are", "was"]


def recall(docs: DataFrame, asked: str) -> DataFrame:
    """(doc_id, tier) of the strictest reading of ``asked`` with a hit: the phrase (0), all its words (1), any word that counts (2).

    One scan rates each document; the best tier is one row.
    """
    words = [w for w in re.split(r"[^a-z0-9]+", asked.lower()) if w]
    loose = [w for w in words if len(w) > 2 and w not in STOPWORDS]
    held = docs.select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("words"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    every, some = F.lit(bool(words)), F.lit(False)
    for w in words:
        every = every & F.array_contains("words", w)
    for w in loose:
        some = some | F.array_contains("words", w)
    tier = F.when(F.lit(bool(words)) & F.contains(joined, F.lit(f" {' '.join(words)} ")), 0).when(every, 1).when(some, 2)
    rated = held.select("doc_id", tier.alias("tier")).where("tier IS NOT NULL")
    best = rated.agg(F.min("tier").alias("best"))
    return rated.join(F.broadcast(best)).where("tier = best").select("doc_id", "tier")
