"""Ranked search against a plain count of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, corpus, frame
from threadloom.llm import lexical_search
from threadloom.llm.lexical_search import best, build, search, term_counts, term_hashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    total, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in {x for x in items if x[0] is not None}:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, counts in docs:
            n, score = sum(counts.values()), 0
            for t in wanted:
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * n * total) // words
                    score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def items(texts):
    rng = random.Random(4)
    found = [(i, " ".join(rng.choice(rng.choice(texts).split(" ")) for _ in range(6))) for i in range(25)]
    return [*found, found[0], (3, "w1 w1 W1 extra"), (90, None), (91, ""), (92, "!? .."), (None, "w1"), (93, "É été 数 naïve-x"), (94, "absent-everywhere")]


@pytest.mark.parametrize("small", [False, True], ids=["whole", "many shards, passes and blocks"])
def test_search(spark, monkeypatch, small):
    if small:  # workers import the module anew, so only what the driver reads is changed; its shards come from small batches
        monkeypatch.setattr(lexical_search, "TERMS_IN_PASS", 20)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    texts = [t + "\nW1, w2; w3-w4 ÉTÉ" * (i % 3) for i, t in enumerate(corpus(n=60))]
    rows = [*awkward(texts), (None, "w1 w2", None, None, None, None, None, None, None)]
    asked = items(texts)
    try:
        index = build(frame(spark, rows))
        got = [tuple(r) for r in search(index, spark.createDataFrame([(*x, 1, 2) for x in asked], "item_id long, text string, rank int, score int").repartition(2)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == plain([r[:2] for r in rows], asked)
    assert index.documents == sum(bool(terms(r[1])) for r in rows if r[0] is not None)


def test_search_of_nothing(spark):
    docs, asked = frame(spark, awkward(corpus(n=5))), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert search(build(docs.limit(0)), asked).count() == 0
    assert search(build(docs), asked.limit(0)).count() == 0
    assert search(build(docs.where("doc_id < 0 OR text = ''")), asked).count() == 0


def test_long_texts_are_cut_between_terms():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é-数.") for _ in range(rng.choice([0, 1, 30, 900]))) for _ in range(50)] + [None, "x" * 500, " " * 300]
    column = pa.array(texts)
    want = term_hashes(column)
    for block in (1, 16, 100):
        rows, hashes = term_hashes(column, block)
        assert rows.tolist() == want[0].tolist() and hashes.tolist() == want[1].tolist()
    assert np.bincount(want[0], minlength=len(texts)).tolist() == term_counts(column).tolist() == [len(terms(t)) for t in texts]


def test_ties_at_the_border_go_to_small_ids():
    ids = np.array([9, 3, 7, 1, 5, 4])
    sums = np.array([2, 5, 2, 2, 0, 2])
    assert sorted(ids[best(sums, ids, 3)].tolist()) == [1, 3, 4]
    assert sorted(ids[best(sums, ids, 9)].tolist()) == [1, 3, 4, 7, 9]
