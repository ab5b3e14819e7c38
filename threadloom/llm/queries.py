"""One query for each operator of this package, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import lexical_search
from threadloom.llm.ann import search
from threadloom.llm.chat_format import ORACLE as CHAT_SQL
from threadloom.llm.chat_format import PROBE, format_turns, read_back, text_parts
from threadloom.llm.conversation_repair import repaired_digests
from threadloom.llm.html_extract import extract
from threadloom.llm.jaccard_join import ORACLE as JACCARD_SQL
from threadloom.llm.jaccard_join import jaccard_join
from threadloom.llm.license_scan import license_scan
from threadloom.llm.line_dedup import ORACLE as LINES_SQL
from threadloom.llm.line_dedup import line_dedup
from threadloom.llm.mix_sources import ORACLE as MIX_SQL
from threadloom.llm.mix_sources import mix_sources
from threadloom.llm.packing import pack
from threadloom.llm.quality_ranker import rank_quality
from threadloom.llm.quality_rules import quality_rules
from threadloom.llm.token_counts import head_body_tail, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search(vectors, F.col("vec_id") % 100 == 0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the first line, the last line and what lies between, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", head_body_tail(F.col("text")).alias("sections"))
    counts = token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/shard/name; the first of each shard of 64 is its licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    name = F.when(F.col("doc_id") % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 64).cast("string"), name)
    return license_scan(docs.withColumn("path", path)).select("doc_id", "path", "license", "how", "cosine", "license_path")


def op6_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_exact", "n_near", F.md5("text").alias("text_md5"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and two turns that hold another template's control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(text_parts(rows.unionByName(spark.sql(f"SELECT * FROM {PROBE}")))))


def queries() -> dict:
    found = [
        op1_ann, op2_quality_rules, op3_token_counts, op4_mix_sources, op5_license_scan, op6_quality_ranker, op7_line_dedup, op8_jaccard_join,
        op9_packing, op10_html_extract, op11_lexical_search, op12_conversation_repair, op13_chat_format,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": MIX_SQL, "op7_line_dedup": LINES_SQL, "op8_jaccard_join": JACCARD_SQL, "op11_lexical_search": lexical_search.ORACLE, "op13_chat_format": CHAT_SQL}
