"""Operator 7: near-duplicate line removal by a deletion-neighbourhood join, DataFrame functions only.

Lines are the \\n-split pieces of a text; words are runs of ``[^\\x20\\x09-\\x0D]``.
Lines stand in the order (doc_id, line number). A line goes if an earlier line has
the same text, or if both have ``min_words`` words or more and differ by at most one
word put in, taken out or replaced. Lines without a word always stay. This rule is
local: an earlier line counts whether or not it goes itself.

How: equal lines meet by a 128-bit hash, of which only the earliest occurrence goes on.
Lines within the bound agree in their first or their last half (of the shorter line),
so lines whose halves nobody shares are settled by one count. The others emit every
variant with one word left out, in the half that may differ, as hashed keys: with the
position for a replaced word, and against the whole of shorter lines for a word more.
All lines under a replacement key are within the bound of each other and each meets the
earliest; under a deletion key each meets the one whole line. So pairs grow with the
lines, not with the square of a group. Each pair's words are compared at last.

Defined results: null text stays null; empty text is one empty line and stays; rows that
share a doc_id count as one document and are treated alike when their texts are equal;
rows without a doc_id have no place in the order and stay as they are, uncompared;
an empty table gives no rows; other columns pass through; n_chars, if there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.marks import marks, slot, with_mark
from threadloom.session import written

SPACES = r"[\x20\x09-\x0D]+"
#: white space in a line, besides the space
BLANKS = "\t\x0b\x0c\r"
#: hashes that are summed over a line stay below this, so that 2**27 words fit a long
MODULUS = 1 << 36


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, SPACES), lambda w: w != "")


def spaced(line: Column) -> Column:
    """A line's words with one space between them; most lines are so already, which is told without a regular expression."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    for c in BLANKS:
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.btrim(F.regexp_replace(line, SPACES, " "))).otherwise(line)


def each_line(docs: DataFrame) -> DataFrame:
    """(doc_id, no, line) of the lines that hold a word."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.ltrim("line", F.lit(" " + BLANKS)) != "")


def half_keys(n: Column, line: Column) -> Column:
    """For the shorter length m = n and m = n - 1: the hashes of the first m // 2 and the last m - m // 2 words of a ``spaced`` line."""
    words = lambda k: F.call_function("substring_index", line, F.lit(" "), k)

    def pair(m: Column) -> list[Column]:
        a = F.shiftright(m, 1)
        return [F.xxhash64(F.lit(0), m, words(a)), F.xxhash64(F.lit(1), m, words(a - m))]

    return F.array(*pair(n), *pair(n - 1))


def first_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Earliest (doc_id, no) of each distinct line, with its half keys (null under ``min_words`` words)."""
    keyed = each_line(docs).withColumn("words", spaced(F.col("line")))
    keyed = keyed.withColumn("n", F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    keyed = keyed.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.struct("doc_id", "no", F.when(F.col("n") >= min_words, half_keys(F.col("n"), F.col("words"))).alias("halves")).alias("at"),
    )
    return keyed.groupBy("h1", "h2").agg(F.min("at").alias("at")).select("at.*")


def candidates(firsts: DataFrame) -> DataFrame:
    """(doc_id, no, in_tail, in_head) of lines that share a half with another: where the edit may lie."""
    keys = firsts.where("halves IS NOT NULL").select("doc_id", "no", F.posexplode("halves").alias("side", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    found = keys.join(shared, "key", "left_semi")
    tail = F.col("side") % 2 == 0
    return found.groupBy("doc_id", "no").agg(F.bool_or(tail).alias("in_tail"), F.bool_or(~tail).alias("in_head"))


def variants(lines: DataFrame) -> DataFrame:
    """(key, kind, doc_id, no): S a word replaced, D a word left out, W a whole line.

    A line's words give sums of hashes, so that each variant takes a few steps at any length
    of line: S takes one word off the sum over (word, position), D one off the sum over
    neighbouring words. S keys hold position and sum, so equal keys are lines within the bound; D and W keys can
    also agree for other orders of the same neighbours, which the comparison of words tells.
    """
    n, i0 = F.size("h"), F.lit(0)
    at = lambda i: F.when(i >= 0, F.coalesce(F.get("h", i), i0)).otherwise(i0)
    place = lambda seed, i: F.pmod(F.xxhash64(F.lit(seed), at(i), i), F.lit(MODULUS))
    pair = lambda seed, i, j: F.pmod(F.xxhash64(F.lit(seed), at(i), at(j)), F.lit(MODULUS))
    plus = lambda s, x: s + x
    zero = F.lit(0).cast("long")
    lines = lines.select("doc_id", "no", "in_tail", "in_head", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    places, pairs = F.sequence(i0, n - 1), F.sequence(F.lit(-1), n - 1)
    total = lambda hashes: F.aggregate(hashes, zero, plus)
    lines = lines.select(
        "*", F.transform(places, lambda i: place(1, i)).alias("p1s"), F.transform(places, lambda i: place(2, i)).alias("p2s"),
        F.transform(pairs, lambda i: pair(3, i, i + 1)).alias("g3s"), F.transform(pairs, lambda i: pair(4, i, i + 1)).alias("g4s"),
    )
    lines = lines.select("*", *(total(F.col(f"{c}s")).alias(c) for c in ("p1", "p2", "g3", "g4")))
    half = F.floor((n - 1) / 2).cast("int")
    low = F.when(F.col("in_head"), i0).otherwise(half)
    high = F.when(F.col("in_tail"), n - 1).otherwise(F.least(half + 1, n - 1))
    where = F.sequence(low, high)
    replaced = lambda i: F.xxhash64(F.lit(7), n, i, F.col("p1") - F.get("p1s", i), F.col("p2") - F.get("p2s", i))
    left = lambda k, i: F.col(f"g{k}") - F.get(f"g{k}s", i) - F.get(f"g{k}s", i + 1) + pair(k, i - 1, i + 1)
    one = lambda key, kind: F.struct(key.alias("key"), F.lit(kind).alias("kind"))
    return lines.select(
        "doc_id", "no",
        F.inline(F.concat(
            F.transform(where, lambda i: one(replaced(i), "S")),
            F.transform(where, lambda i: one(F.xxhash64(F.lit(8), n - 1, left(3, i), left(4, i)), "D")),
            F.array(one(F.xxhash64(F.lit(8), n, F.col("g3"), F.col("g4")), "W")),
        )),
    )


def near_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, no, other_doc, other_no): lines under an S key with that key's earliest, D lines with the whole lines of their key."""
    keyed = written(variants(lines), "variants")
    at = F.struct("doc_id", "no")
    groups = keyed.groupBy("key", "kind").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    first = groups.where("kind = 'S' AND n > 1").select("key", F.col("first").alias("mate"))
    replaced = keyed.where("kind = 'S'").join(first, "key")
    whole = keyed.where("kind = 'W'").select("key", at.alias("mate"))
    shorter = keyed.where("kind = 'D'").join(whole, "key")
    pairs = replaced.unionByName(shorter).where(~((F.col("mate.doc_id") == F.col("doc_id")) & (F.col("mate.no") == F.col("no"))))
    return pairs.select("doc_id", "no", F.col("mate.doc_id").alias("other_doc"), F.col("mate.no").alias("other_no")).distinct()


def within_one(x: Column, y: Column) -> Column:
    """Whether word arrays ``x`` and ``y`` differ by at most one word put in, taken out or replaced."""
    n, m = F.size(x), F.size(y)
    short = F.least(n, m)

    def same(i: Column) -> Column:
        return F.get(x, i) == F.get(y, i)

    def same_back(i: Column) -> Column:
        return F.get(x, n - 1 - i) == F.get(y, m - 1 - i)

    def run(test) -> Column:
        breaks = F.filter(F.sequence(F.lit(0), short), lambda i: (i == short) | ~F.coalesce(test(i), F.lit(False)))
        return F.get(breaks, F.lit(0))

    return (F.abs(n - m) <= 1) & (run(same) + run(same_back) >= F.greatest(n, m) - 1)


def dropped_lines(docs: DataFrame, min_words: int = 8, max_edits: int = 1) -> DataFrame:
    """(doc_id, no, exact) of the lines that go; ``exact`` tells equal lines from near ones."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    firsts = written(first_lines(docs, min_words), "first_lines")
    kept = firsts.select("doc_id", "no")
    lines = each_line(docs)
    repeated = lines.select("doc_id", "no").distinct().join(kept, ["doc_id", "no"], "left_anti").withColumn("exact", F.lit(True))
    if not max_edits:
        return repeated
    found = candidates(firsts).groupBy("doc_id").agg(F.collect_list(F.struct("no", "in_tail", "in_head")).alias("found"))
    found = written(found, "candidates")
    # one plan at every size: the candidates grow with the texts; only texts in a slot of one are shuffled
    near = with_mark(docs.where("doc_id IS NOT NULL").withColumn("_slot", slot(F.col("doc_id"))), marks(found.select(slot(F.col("doc_id")).alias("_slot"))))
    held = near.where("_mark").select("doc_id", "text").join(found.hint("merge"), "doc_id")
    held = held.select("doc_id", F.split("text", "\n").alias("lines"), "found")
    words = lambda f: words_of(F.get("lines", f["no"])).alias("words")
    texts = held.select("doc_id", F.inline(F.transform("found", lambda f: F.struct(f["no"].alias("no"), f["in_tail"].alias("in_tail"), f["in_head"].alias("in_head"), words(f)))))
    texts = texts.where(F.size("words") >= min_words).groupBy("doc_id", "no").agg(F.bool_or("in_tail").alias("in_tail"), F.bool_or("in_head").alias("in_head"), F.min("words").alias("words"))
    texts = written(texts, "candidate_lines")
    pairs = written(near_pairs(texts), "line_pairs")
    mine = texts.select("doc_id", "no", "words")
    other = texts.select(F.col("doc_id").alias("other_doc"), F.col("no").alias("other_no"), F.col("words").alias("other_words"))
    checked = pairs.join(mine, ["doc_id", "no"]).join(other, ["other_doc", "other_no"]).where(within_one(F.col("words"), F.col("other_words")))
    at, mate = F.struct("doc_id", "no"), F.struct(F.col("other_doc").alias("doc_id"), F.col("other_no").alias("no"))
    near = checked.select(F.greatest(at, mate).alias("at")).distinct().select("at.doc_id", "at.no", F.lit(False).alias("exact"))
    return repeated.unionByName(near)


def line_dedup(docs: DataFrame, min_words: int = 8, max_edits: int = 1) -> DataFrame:
    """``docs`` with the kept lines as text, and n_lines, n_exact, n_near: lines, and those gone as equal or near."""
    docs = docs.drop("n_lines", "n_exact", "n_near")
    gone = dropped_lines(docs.select("doc_id", "text"), min_words, max_edits)
    by_doc = gone.groupBy("doc_id").agg(
        F.collect_set("no").alias("_gone"), F.count_if("exact").alias("_exact"), F.count_if(~F.col("exact")).alias("_near")
    )
    by_doc = written(by_doc, "gone").withColumnRenamed("doc_id", "_of")
    # a transform of one element splits a text once; a column of its lines would be split again for each line
    rest = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(F.split("text", "\n")), rest), F.lit(0)))
    # one plan at every size: the lost lines grow with the texts
    out = docs.join(by_doc.hint("merge"), docs["doc_id"] == by_doc["_of"], "left")
    zero = F.lit(0).cast("long")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    out = out.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_exact", zero).alias("n_exact"), F.coalesce("_near", zero).alias("n_near"),
    )
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


#: DuckDB SQL for op7's rows on documents: all earlier lines that share a variant with one word left out, compared word by word.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents
), held AS (SELECT doc_id, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), firsts AS (SELECT line, min((doc_id, no)) AS place, any_value(w) AS w FROM held GROUP BY line
), long AS (SELECT place, w, len(w) AS n FROM firsts WHERE len(w) >= 8
), cut AS (SELECT place, n, unnest(range(1, n + 1)) AS i, w FROM long
), without AS (SELECT place, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS rest FROM cut
), pairs AS (
  SELECT a.place AS x, b.place AS y FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.n = b.n AND a.place > b.place
  UNION SELECT greatest(a.place, b.place), least(a.place, b.place) FROM without a JOIN long b ON a.n = b.n + 1 AND a.rest = array_to_string(b.w, ' ')
), gone AS (
  SELECT doc_id, no, true AS exact FROM held h WHERE (doc_id, no) NOT IN (SELECT place FROM firsts)
  UNION ALL SELECT DISTINCT x[1], x[2], false FROM pairs
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_near,
         coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (g.doc_id IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, md5(kept.text) AS text_md5
FROM documents d LEFT JOIN kept USING (doc_id)
"""
