"""Small corpora with the awkward rows that every operator must take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, component_id string, gone string"


def words(n, rng, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=40):
    """Texts of several lines with exact and near copies among them."""
    rng = random.Random(seed)
    texts = []
    for k in range(n):
        if k and rng.random() < 0.35:
            lines = [line.split(" ") for line in texts[rng.randrange(len(texts))].split("\n")]
            for _ in range(rng.randrange(4)):
                line = rng.choice(lines)
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = [f"new{rng.randrange(50)}"]
            texts.append("\n".join(" ".join(line) for line in lines))
        else:
            texts.append("\n".join(" ".join(words(rng.randrange(1, 40), rng)) for _ in range(rng.randrange(1, 6))))
    return texts


def awkward(texts):
    """Rows in SCHEMA: the texts, and nulls, blanks, repeats and a very long text; extra columns bear output names."""
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], len(t), "x", "x", "x", "x") for i, t in enumerate(texts)]
    n = len(rows)
    long_text = "\n".join(" ".join(f"u{i * 50 + j}" for j in range(50)) for i in range(400))
    rows += [
        (n, None, "en", "a", None, None, None, None, None), (n + 1, "", "en", "a", 0, None, None, None, None), (n + 2, " \n\t\n", None, None, 4, None, None, None, None),
        (n + 3, long_text, "en", "a", len(long_text), None, None, None, None), (n + 4, "one", "de", "c", 3, None, None, None, None),
        (n + 5, "É été   naïve x 数 据", None, None, 3, None, None, None, None),
    ]
    return [*rows, rows[0], rows[0]]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
