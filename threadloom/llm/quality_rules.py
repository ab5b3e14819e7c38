"""Operator 2: rule-based quality filter with n-gram perplexity bands.

Each language (null is one of its own) has a modified Kneser-Ney model over the 5-grams of
its different texts' code points (see ``kneser_ney``), counted by Spark over every whole text and kept
as sorted hash arrays in the shared folder, which tasks map into memory. A document's
perplexity is that of its code points under the model of its language.

Each language gets a lower and an upper band about the median of the log perplexity of the
different texts that pass the base rules: ``median - lower * s`` and ``median + upper * s``.
s is the interquartile range over 1.349, at least ``floor`` times that of all languages
together (so that copies can't make a band thin), and is widened by ``1 + prior / n`` for n
texts, so that a language with few texts rejects few.

Defined results: null text counts as empty; an empty text has n_words 0, fails the
base rules and has null perplexity; repeated rows are each judged alone and alike, and count
once for the bands; an empty table gives no rows; extra columns pass through unless they
bear an output name, in which case the output wins. Text length is unlimited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.arrays import Texts, mix, windows
from threadloom.llm.batches import only, slices
from threadloom.llm.kneser_ney import Grams, HashArrays, fit
from threadloom.session import written

# Fixed value: the symbols that the base contract counts.
SYMBOLS = "#*$%&|<>"

COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "perplexity": "double",
}


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The base contract's counters of each row."""
    words = np.diff(texts.word_at)
    symbols = np.zeros(256, bool)
    symbols[[ord(c) for c in SYMBOLS]] = True
    starts, ends, of_line = texts.lines()
    filled = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    key = mix(texts.hashes(starts, ends) ^ mix(of_line.astype(np.uint64)))[filled]
    of_line = of_line[filled]
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    rows = texts.word_rows()
    grams, at = windows(texts.word_hashes(), rows, 3)
    covered = np.zeros(len(rows) + 1, np.int64)
    if len(grams):
        key = mix(grams ^ mix(rows[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 3, -1)
    repeat = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
    return {
        "n_words": words,
        "word_chars": texts.row_sums(texts.inside & ((texts.raw & 0xC0) != 0x80)),
        "n_symbols": texts.row_sums(symbols[texts.raw]),
        "n_dup_lines": np.bincount(of_line[again], minlength=texts.n).astype(np.int64),
        "n_repeat_words": np.bincount(rows, repeat, texts.n).astype(np.int64),
    }


def scored(docs: DataFrame, model: HashArrays, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the base counters, base_failed, perplexity and _print, a hash of the text."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType(fields + list(T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in COLUMNS.items()) + ", _print long")))
    inputs = list(dict.fromkeys([*keep, "lang", "text"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("scores")
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                out = base_counts(texts)
                failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
                grams = Grams(texts, part.column("lang"))
                total = np.bincount(grams.rows, model.find(grams.keys), texts.n)
                chars = np.bincount(grams.rows, minlength=texts.n)
                ppl = np.exp(-total / np.maximum(chars, 1))
                prints = texts.hashes(texts.at[:-1], texts.at[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(v) for v in out.values()] + [pa.array(failed), pa.array(ppl, mask=chars == 0), pa.array(prints)],
                    names=schema.names,
                )

    return docs.select(*inputs).mapInArrow(score, schema)


def bands(scores: DataFrame, lower: float, upper: float, floor: float, prior: float) -> DataFrame:
    """(_lang, low, high) of each language in ``scores`` (lang, base_failed, perplexity, _print)."""
    once = scores.where("NOT base_failed").groupBy("lang", "_print").agg(F.min(F.log("perplexity")).alias("x"))
    marks = F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias("q")
    every = once.agg(marks).select(((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("all_s"))
    own = once.groupBy(F.col("lang").alias("_lang")).agg(F.count("x").alias("n"), marks)
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, floor * F.col("all_s")) * (1 + prior / F.col("n"))
    middle = F.col("q")[1]
    return own.join(F.broadcast(every)).select("_lang", F.exp(middle - lower * spread).alias("low"), F.exp(middle + upper * spread).alias("high"))


def quality_rules(
    docs: DataFrame, columns: list[str] | None = None, lower: float = 8.0, upper: float = 3.5, floor: float = 0.5, prior: float = 30.0
) -> DataFrame:
    """``docs`` (text, lang, ...), or those of their ``columns``, with ``COLUMNS``, low, high and ``kept``.

    The scores are written once with these columns, so leave the text out where it isn't needed.
    """
    docs = docs.drop(*COLUMNS, "low", "high", "kept", "_lang", "_print")
    keep = docs.columns if columns is None else [c for c in columns if c in docs.columns]
    scores = written(scored(docs, fit(docs), list(dict.fromkeys([*keep, "lang"]))), "scores")
    limits = written(bands(scores, lower, upper, floor, prior), "bands")
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    out = scores.join(limits, scores["lang"].eqNullSafe(limits["_lang"]), "left")
    return out.withColumn("kept", ~F.col("base_failed") & inside).select(*keep, *COLUMNS, "low", "high", "kept")
