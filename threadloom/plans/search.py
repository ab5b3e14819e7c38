"""Search queries over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.text import snippet
from threadloom.operators import search as Q
from threadloom.plans.registry import query

WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


def bm25_sql(words: list[str], source: str = "documents") -> str:
    tf = ", ".join(f"len(list_filter(words, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(words)))
    part = " + ".join(f"ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for k in range(len(words)))
    every = " AND ".join(f"tf{k} > 0" for k in range(len(words)))
    return f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM {source}), h AS (SELECT doc_id, len(words) AS dl, {tf} FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM h) SELECT doc_id, round({part}, 6) AS score FROM h, s WHERE {every}"""


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents), t AS (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM w)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""")
def q01_postings(t):
    p = Q.postings(t.documents)
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({WORDS}, ' ') || ' ', ' of the ')")
def q02_phrase(t):
    return Q.phrase(t.documents, ["of", "the"]).select("doc_id")


@query(bm25_sql(["the", "and"]))
def q03_bm25(t):
    return Q.bm25(t.documents, ["the", "and"]).withColumn("score", F.round("score", 6))


@query(f"SELECT DISTINCT source FROM documents WHERE list_contains({WORDS}, 'idiot')")
def q04_match_ids(t):
    return Q.phrase(t.documents, ["idiot"]).select("source").distinct()


@query(bm25_sql(["the", "that"], "(SELECT * FROM documents WHERE lang = 'en' AND contains(source, '1'))"))
def q05_filtered(t):
    """Filters hold before ranking."""
    own = t.documents.where((F.col("lang") == "en") & F.contains("source", F.lit("1")))
    return Q.bm25(own, ["the", "that"]).withColumn("score", F.round("score", 6))


@query(f"""WITH b AS ({bm25_sql(["the", "of"])}), k AS (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 10), f AS (SELECT doc_id, text, strpos(lower(text), 'of') AS pos FROM documents JOIN k USING (doc_id))
SELECT doc_id, substring(text, greatest(pos - 40, 1), pos - greatest(pos - 40, 1) + 122) AS snippet FROM f""")
def q06_snippets(t):
    top = Q.bm25(t.documents, ["the", "of"]).withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "doc_id").limit(10)
    return t.documents.join(F.broadcast(top), "doc_id").select("doc_id", snippet(F.col("text"), "of").alias("snippet"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')")
def q07_exact(t):
    return Q.exact(t.documents, "Apache License").select("doc_id")


@query("SELECT doc_id, CAST(count(*) OVER () AS BIGINT) AS total FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 20")
def q08_live_scan(t):
    found = Q.exact(t.documents, "the")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("doc_id").limit(20).join(F.broadcast(total)).select("doc_id", "total")


@query(f"""WITH i AS (SELECT item_id, list_distinct({WORDS}) AS wanted FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS word FROM documents),
u AS (SELECT item_id, len(wanted) AS n, unnest(wanted) AS word FROM i) SELECT item_id, doc_id FROM u JOIN w USING (word) GROUP BY item_id, doc_id HAVING count(*) = any_value(n)""")
def q09_batch(t):
    return Q.batch(t.documents, t.benchmark)


def top_sql(words, k):
    return f"(SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM ({bm25_sql(words)}) ORDER BY score DESC, doc_id LIMIT {k})"


@query(f"""WITH a AS {top_sql(['the', 'and'], 50)}, b AS {top_sql(['of', 'to'], 50)}, p AS (SELECT id, 1.0::DOUBLE / (60.0::DOUBLE + rank) AS part FROM a UNION ALL SELECT id, 0.5::DOUBLE / (60.0::DOUBLE + rank) FROM b)
SELECT id, round(sum(part), 8) AS score FROM p GROUP BY id ORDER BY sum(part) DESC, id LIMIT 20""")
def q12_fusion(t):
    def top(words):
        hits = Q.bm25(t.documents, words).withColumn("score", F.round("score", 6))
        return hits.orderBy(F.col("score").desc(), "doc_id").limit(50).withColumnRenamed("doc_id", "id")

    return Q.fuse([(top(["the", "and"]), 1.0), (top(["of", "to"]), 0.5)], 20).withColumn("score", F.round("score", 8))
