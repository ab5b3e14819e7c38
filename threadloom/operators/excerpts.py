"""Best excerpts: the message of a session that a task's words fit best, with its neighbours."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Saturation, length share, common length, part of a word inside another, weight of the whole task.
K1, B, COMMON_LENGTH, INSIDE, WHOLE = 1.2, 0.75, 40.0, 0.35, 2.5
# Words that a task's query leaves out.
FILLER = (
    "the and for with that this from into our your how what when where why are was were has have had not but all"
).split()


def task_words(task: str) -> list[str]:
    """Distinct words of a task in order, of three bytes or more, without filler."""
    words = re.sub(r"[^\w]", " ", task.lower()).split()
    return list(dict.fromkeys(w for w in words if len(w.encode()) > 2 and w not in FILLER))


def _equals(word: str):
    return lambda token: token == word


def fit(text: Column, needle: str, words: list[str]) -> Column:
    """How well a lower-case text fits, in ten-thousandths: saturated counts of the words, damped by the text's length.

    A word of four bytes or more that only stands inside others counts a part, the whole needle counts extra.
    """

    def score(held: Column) -> Column:
        tokens, length = held["tokens"], F.size(held["tokens"]).cast("double")
        damp = K1 * (1 - B + B * (length / COMMON_LENGTH))
        total = F.lit(0.0)
        for word in words:
            n = F.size(F.filter(tokens, _equals(word))).cast("double")
            if "_" not in word and len(word.encode()) >= 4:
                n = F.when(n > 0, n).when(F.contains(held["text"], F.lit(word)), INSIDE).otherwise(0.0)
            total = total + F.when(n > 0, n * (K1 + 1) / (n + damp)).otherwise(0.0)
        if needle.strip():
            total = total + F.when(F.contains(held["text"], F.lit(needle.strip())), WHOLE * (K1 + 1) / (1 + damp)).otherwise(0.0)
        return F.when(length == 0, F.lit(0)).otherwise(F.round(total * 10_000)).cast("long")

    tokens = F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), 0)
    held = F.struct(text.alias("text"), tokens.alias("tokens"))
    return F.get(F.transform(F.array(held), score), F.lit(0))  # tokens are made once


def cut(text: Column, most: int) -> Column:
    """struct(text, cut): ``text`` trimmed, at most ``most`` bytes of whole characters; an open code fence is closed and a cut marked."""
    bare = F.regexp_replace(text, r"^\s+|\s+\z", "")
    head = F.make_valid_utf8(F.substring(bare.cast("binary"), 1, most).cast("string"))
    head = F.regexp_replace(F.regexp_replace(head, "�\\z", ""), r"\s+\z", "")
    fence = F.when(F.regexp_count(head, F.lit("```")) % 2 == 1, "\n```").otherwise("")
    short = F.when(head == "", head).otherwise(F.concat(head, fence, F.lit("…")))
    long = F.octet_length(bare) > most
    return F.struct(F.when(long, short).otherwise(bare).alias("text"), long.alias("cut"))


def best_windows(messages: DataFrame, task: str, most: int = 4096) -> DataFrame:
    """(session_id, score, lo, hi, excerpt): each session's best window for ``task`` among ``messages`` (session_id, msg_idx, role, text).

    Tool messages and blank texts are left out. The earliest best message wins, with the eligible
    message before it and the one after; lo and hi bound their indexes, hi beyond the last. One shuffle by session;
    the window keeps three rows of a session at a time.
    """
    held = messages.where("role <> 'tool' OR role IS NULL").select("session_id", "msg_idx", "role", cut(F.col("text"), most).alias("_cut"))
    held = held.select("session_id", "msg_idx", "role", "_cut.text", "_cut.cut").where("text <> ''")
    scored = held.withColumn("score", fit(F.lower("text"), task.lower(), task_words(task)))
    order = Window.partitionBy("session_id").orderBy("msg_idx")
    own = F.struct("msg_idx", "role", "text", "cut")
    near = F.array_compact(F.array(F.lag(own).over(order), own, F.lead(own).over(order)))
    best = scored.withColumn("excerpt", near).groupBy("session_id").agg(F.max_by(F.struct("score", "excerpt"), F.struct("score", -F.col("msg_idx"))).alias("best"))
    lo, hi = F.array_min("best.excerpt.msg_idx"), F.array_max("best.excerpt.msg_idx") + 1
    return best.select("session_id", "best.score", lo.alias("lo"), hi.alias("hi"), "best.excerpt")
