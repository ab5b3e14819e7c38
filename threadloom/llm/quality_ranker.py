"""Operator 6: quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text. For every
preference pair (a labelled 1 over a labelled 0) the model is logistic in the difference
of strengths; weights minimise the mean logistic loss plus a small ridge, by Newton steps.
The strength at the quantile that equals the share of label 0 in the sample is the
threshold, and the score is the logistic function of the distance from it.

Labels are read from training rows only (crc32(doc_id as text) mod 3 is not 1), at most
``max_labelled`` of them in the order of a hash of doc_id, and ``pairs`` pairs of them; these
bounds are parameters, and only the sampled rows' features reach the driver. Features come
from the text alone: labels, lang, source and doc_id are never inputs.

Defined results: null text counts as empty and is scored like any text; a doc_id with
several labels counts once with the smallest; without labels of both kinds every score is
0.5; repeated rows score alike; a null doc_id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrays import Texts
from threadloom.llm.batches import slices
from threadloom.llm.quality_rules import base_counts

MAX_LABELLED, PAIRS, RIDGE, SEED = 20_000, 200_000, 1e-3, 6
# The bytes and byte groups whose shares are features.
GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>", "pipe": b"|", "bang": b"!?", "stop": b".", "comma": b",",
    "bracket": b"()[]{}", "quote": b"\"'`", "other": b"=+@/\\_~^:;-", "line": b"\n", "tab": b"\t",
}


def features(texts: Texts) -> np.ndarray:
    """(rows, features), each within a bounded range."""
    size = np.maximum(np.diff(texts.at), 1).astype(np.float64)
    counts = base_counts(texts)
    words = np.maximum(counts["n_words"], 1).astype(np.float64)
    columns = [np.log1p(counts["n_words"]) / 10, counts["word_chars"] / words / 20, counts["n_dup_lines"] / words, counts["n_repeat_words"] / words]
    for group in GROUPS.values():
        table = np.zeros(256, np.int64)
        table[list(group)] = 1
        share = texts.row_sums(table[texts.raw]) / size
        columns += [share, np.sqrt(share)]
    columns.append(texts.row_sums(texts.raw >= 128) / size)
    rows = texts.word_rows()
    if len(rows):
        first, last = texts.raw[texts.starts], texts.raw[texts.ends - 1]
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
        upper = np.zeros(256, np.int64)
        upper[65:91] = 1
        ups = np.concatenate([[0], np.cumsum(upper[texts.raw])])
        loud = (ups[texts.ends] - ups[texts.starts] > 1)
        for flags in (~letter[first], ~letter[last], upper[first] > 0, loud, texts.ends - texts.starts > 20, texts.ends - texts.starts == 1):
            columns.append(np.bincount(rows, flags, texts.n) / words)
    else:
        columns += [np.zeros(texts.n)] * 6
    return np.nan_to_num(np.stack(columns, axis=1))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and threshold from features and 0/1 labels."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return weights, 0.0
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - centre) / scale
    rng = np.random.default_rng(SEED)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
        gradient = -(d * p[:, None]).mean(0) + RIDGE * weights
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = weights / scale
    return weights, float(np.quantile(x @ weights, len(bad) / len(label)))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def feature_rows(docs: DataFrame) -> DataFrame:
    """(label, x) of each row of ``docs`` (label, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(features(Texts(part.column("text")))), pa.list_(pa.float64()))], names=["label", "x"])

    return docs.select("label", "text").mapInArrow(read, "label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, pairs: int = PAIRS) -> tuple[np.ndarray, float]:
    """The model of the training rows of ``labels`` (doc_id, quality) and their texts in ``docs`` (doc_id, text)."""
    usable = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
    one = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # of the texts of a repeated id the first in order; at most ``max_labelled`` rows
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = feature_rows(texts).toArrow()
    if not got.num_rows:
        return np.zeros(features(Texts(pa.array([""]))).shape[1]), 0.0
    x, label = np.stack(got.column("x").to_numpy()), got.column("label").to_numpy()
    order = np.lexsort([*x.T[::-1], label])
    return fit(x[order], label[order], pairs)


def rank_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled, pairs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, threshold = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                far = features(Texts(part.column("text"))) @ weights - threshold
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(far, -500, 500))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
