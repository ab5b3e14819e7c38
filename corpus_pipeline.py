"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
Rows that repeat a doc_id stay or go together.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.jaccard_join import jaccard_join
from threadloom.llm.line_dedup import line_dedup
from threadloom.llm.marks import marks, slot, with_mark
from threadloom.llm.mix_sources import mix_sources
from threadloom.llm.packing import pack
from threadloom.llm.quality_rules import quality_rules
from threadloom.session import delete, made, written


#: what the result of the stage before reads; that result is written when the next stage begins
_held: list[str] = []


def stage(f):
    """Deletes the tables that the stage before worked with."""

    @functools.wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if STAGES[0][1] is begin:
            _held.clear()  # another run's result may still be read
        delete(spark, _held)
        before = len(made)
        out = f(spark, docs, sf_dir)
        _held[:] = made[before:]
        return out

    return begin


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go."""
    return quality_rules(docs).where("kept").select(*docs.columns)


@stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go, and with them documents that have no word left."""
    found = line_dedup(docs)
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    found = jaccard_join(docs)
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # only rows in a slot of a lost id are shuffled
    rows = with_mark(docs.withColumn("_slot", slot(F.col("doc_id"))), marks(gone.select(slot(F.col("doc_id")).alias("_slot"))))
    stay = rows.where("NOT _mark").select(*docs.columns)
    return stay.unionByName(rows.where("_mark").join(gone, "doc_id", "left_anti").select(*docs.columns))


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once, or once an epoch."""
    mixed = mix_sources(docs)
    times = F.array_repeat(F.lit(0), F.col("copies"))
    return mixed.withColumn("time", F.explode(times)).select(*docs.columns)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mix_sources", mix_stage),
    ("packing", packing_stage),
]

#: SQL can't express the perplexity model; a test holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
