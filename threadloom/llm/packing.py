"""Operator 9: harmonic packing of tokenised documents into sequences of ``capacity`` tokens.

A document is its token ids and one end id. It is cut from the front: whole
sequences first; a rest of r tokens has the reciprocal class k = capacity // r. If k
such pieces fill a sequence to ``1 - slack`` the rest is one piece of class k, else
exactly capacity // (k + 1) tokens go to class k + 1 and the rule applies to what
remains. A bin of class k holds k pieces, so bins fill independently on all workers:
a piece's place in its class is a distributed prefix sum of counts by (class, coarse
hash, fine hash) and its bin is place // k. The hash is of the piece and its place in its
task's output, so no document and no copies make a hot group. The pieces of the last,
unfilled bin of each class are packed best fit decreasing in one small task: capacity // r
has some 2 sqrt(capacity) values, so at 4096 they are at most ``most_left()``, about 40,000, pieces whatever the input.

Tokens are looked up by word: the tokenizer's normaliser and pre-tokeniser never join
characters across 0x20 or 0x09-0x0D, nor an ASCII letter or digit and a mark after it, so
a text's ids are those of such units in turn. Ids depend only on the unit, in any ASCII
case, and are kept in a bounded cache. A new unit of lower-case Latin letters goes to the
tokenizer's model at once, if its normaliser and pre-tokeniser would hand it over whole.

Defined results: null and empty texts have the end id alone; repeated rows are each
packed; long texts are cut as any other; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.arrays import Texts
from threadloom.llm.batches import held, only, slices
from threadloom.session import written

CAPACITY = 4096
END_ID = 2
CACHE_WORDS = 250_000
#: sequence_id = bin * SPAN + class; class 0 holds the left-over pieces
SPAN = 8192
#: new words encoded as one text
JOINED = 500



def cuts(n: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, from the front."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest * k >= capacity * (1 - slack):
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


def most_left(capacity: int = CAPACITY) -> int:
    """The most pieces that can stand in unfilled bins: k - 1 for each class that a rest can have."""
    classes = {capacity // r + more for r in range(1, capacity) for more in (0, 1)}
    return sum(k - 1 for k in classes)


class WordIds:
    """Token ids of words from a tokenizer file, kept in flat arrays and found by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special)
        self.model = self.tokenizer.model
        self.letters = self.plain_letters()
        self.plain = re.compile(f"[{''.join(map(chr, self.letters))}]+" if self.letters else "(?!)").fullmatch
        self.clear()

    def plain_letters(self) -> dict[int, str]:
        """Lower-case Latin letters as the model gets them, if the tokenizer hands it words of them whole: then the model's ids are the tokenizer's."""
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and c.islower() and unicodedata.decomposition(c)[:1] != "<"]
        whole = "".join(letters)
        if split is None or (normal and normal.normalize_str(whole) != whole) or any(set(t.content) <= set(letters) for t in self.tokenizer.get_added_tokens_decoder().values()):
            return {}
        given = [split.pre_tokenize_str(c) for c in letters]
        if any(len(g) != 1 for g in given) or [g for g, _ in split.pre_tokenize_str(whole)] != ["".join(g[0][0] for g in given)]:
            return {}
        return {ord(c): g[0][0] for c, g in zip(letters, given)}

    def clear(self) -> None:
        self.found: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.batches = np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """Encodes new distinct words: plain ones by the model alone, others as one text for the tokenizer, set apart by a special token."""
        plain, others, odd = [], [], []
        for w in words:
            if self.plain(w):
                plain.append(w)
            elif not self.special or any(s in w for s in self.special):
                odd.append(w)
            else:
                others.append(w)
        flat, sizes = [], []
        if plain:
            ids, own = [], []
            for w in plain:
                got = self.model.tokenize(w if w.isascii() else w.translate(self.letters))
                own.append(len(got))
                ids.extend([t.id for t in got])
            flat.append(np.array(ids, np.uint32))
            sizes.append(np.array(own))
        if others:
            mark = self.special[0]
            mark_id = self.tokenizer.token_to_id(mark)
            texts = [mark.join(others[a : a + JOINED]) + mark for a in range(0, len(others), JOINED)]
            ids = np.concatenate([np.array(got.ids, np.uint32) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            sizes.append(np.diff(np.flatnonzero(ids == mark_id), prepend=-1) - 1)
            flat.append(ids[ids != mark_id])
        for got in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False):
            flat.append(np.array(got.ids, np.uint32))
            sizes.append(np.array([len(got.ids)]))
        own = np.concatenate(sizes).astype(np.int64)
        self.found.update(zip([*plain, *others, *odd], range(len(self.sizes), len(self.sizes) + len(own))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(own) - own])
        self.sizes = np.concatenate([self.sizes, own])
        self.ids = np.concatenate([self.ids, *flat])
        self.batches = np.concatenate([self.batches, np.zeros(len(own), np.int32)])

    def slots(self, words: list[str]) -> np.ndarray:
        """Where distinct words stand in the arrays; new ones are learned."""
        at = list(map(self.found.get, words))
        new = [w for w, k in zip(words, at) if k is None]
        if len(self.found) + len(new) > CACHE_WORDS:
            self.forget()
            at = list(map(self.found.get, words))
            new = [w for w, k in zip(words, at) if k is None]
        if new:
            self.learn(new)
            at = [self.found[w] if k is None else k for w, k in zip(words, at)]
        return np.array(at, np.int64)

    def of_texts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch end to end, and the offsets of its rows in them."""
        raw = texts.raw
        if not (raw[:-1] == 60).any() or b"<|" not in raw.tobytes():  # special tokens mind their case
            raw = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
        begins = np.zeros(len(raw), bool)
        begins[texts.starts] = True
        begins[1:] |= _ALNUM[raw[:-1]] & _MARK[raw[1:]]
        starts = np.flatnonzero(begins)
        offsets = np.append(np.cumsum(texts.inside)[starts] - 1, texts.inside.sum()).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[texts.inside])))
        coded = units.dictionary_encode()
        slots = self.slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.batches[slots] += 1
        slot = slots[coded.indices.to_numpy()]
        sizes = self.sizes[slot]
        upto = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        ids = self.ids[np.repeat(self.starts[slot] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, texts.at)]

    def forget(self) -> None:
        """Keeps the units that more than one batch has held, if they are half of the cache at most."""
        old, kept = self, np.flatnonzero(self.batches > 1)
        found, ids, starts, sizes = old.found, old.ids, old.starts, old.sizes
        self.clear()
        if not len(kept) or len(kept) > CACHE_WORDS // 2:
            return
        place = np.full(len(sizes), -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.found = {w: int(place[k]) for w, k in found.items() if place[k] >= 0}
        self.sizes = sizes[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = ids[np.repeat(starts[kept] - self.starts, self.sizes) + np.arange(self.sizes.sum())]
        self.batches = np.zeros(len(kept), np.int32)


# Where a letter or digit meets one of these marks the pre-tokeniser always splits.
_ALNUM, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,!?;:*%$&#()[]{}=+@/\\\"~^`-_")] = True


def word_ids(path: str) -> WordIds:
    """One for each worker process, of the last tokenizer file."""
    only(f"words of {path}")
    if not held:
        held[f"words of {path}"] = WordIds(path)
    return held[f"words of {path}"]


def pieces(docs: DataFrame, path: str, capacity: int, slack: float) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, klass, serial) of each piece."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        find = word_ids(path)
        serial = 0
        for batch in batches:
            for part in slices(batch, "text"):
                which, rows = [], []
                flat, at = find.of_texts(Texts(part.column("text")))
                raw = flat.astype("<u4").tobytes()
                for i in range(part.num_rows):
                    ids = raw[4 * at[i] : 4 * at[i + 1]] + end
                    start, n = 0, len(ids) // 4
                    for length, k in cuts(n, capacity, slack):
                        which.append(i)
                        rows.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k))
                        start += length
                start, length, crc, n, k = map(list, zip(*rows))
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").take(pa.array(which)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n, pa.int64()), "klass": pa.array(k, pa.int32()),
                    "serial": pa.array(range(serial, serial + len(k)), pa.int64()),
                })
                serial += len(k)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, klass int, serial long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def places(cut: DataFrame, rows_a_group: int = 500) -> DataFrame:
    """``cut`` with ``place``, the row's index among those of its class, and ``members``, the class's count."""
    groups = max(1, cut.count() // rows_a_group)
    coarse = max(1, round(groups**0.5))
    fine = -(-groups // coarse)
    dealt = cut.withColumn("h", F.xxhash64("doc_id", "start", "ids_crc32", "serial")).select(
        *cut.columns, F.pmod("h", F.lit(coarse)).alias("c"), F.pmod(F.floor(F.col("h") / coarse), F.lit(fine)).alias("f")
    )
    low = dealt.groupBy("klass", "c", "f").agg(F.count("*").alias("n"))
    high = low.groupBy("klass", "c").agg(F.sum("n").alias("n"))
    by_class = Window.partitionBy("klass")
    high = high.select(
        "klass", "c", (F.sum("n").over(by_class.orderBy("c")) - F.col("n")).alias("c_before"), F.sum("n").over(by_class).alias("members")
    )
    within = Window.partitionBy("klass", "c").orderBy("f")
    low = low.select("klass", "c", "f", (F.sum("n").over(within) - F.col("n")).alias("f_before"))
    groups_at = written(low.join(high, ["klass", "c"]), "places")
    row = F.row_number().over(Window.partitionBy("klass", "c", "f").orderBy("doc_id", "start", "length", "ids_crc32", "serial"))
    return (
        dealt.withColumn("row", row).join(groups_at, ["klass", "c", "f"])
        .withColumn("place", F.col("c_before") + F.col("f_before") + F.col("row") - 1)
        .drop("c", "f", "row", "c_before", "f_before")
    )


def best_fit(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        """Longest first, each into the fullest sequence that still takes it."""
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        free: list[tuple[int, int]] = []
        opened, bins, offsets = 0, [], []
        for length in group["length"]:
            at = bisect.bisect_left(free, (length, -1))
            if at == len(free):
                room, b = capacity, opened
                opened += 1
            else:
                room, b = free.pop(at)
            bins.append(b)
            offsets.append(capacity - room)
            if room > length:
                bisect.insort(free, (room - length, b))
        return group.assign(sequence_id=pd.Series(bins, group.index, "int64") * SPAN, offset=pd.Series(offsets, group.index, "int64"))

    return pack


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, slack: float = 1 / 64) -> DataFrame:
    """Pieces of all documents with the sequence and the offset at which each stands."""
    cut = written(pieces(docs, path, capacity, slack), "pieces")
    placed = places(cut).withColumn("bin", F.floor(F.col("place") / F.col("klass")))
    full = F.col("place") < F.col("members") - F.col("members") % F.col("klass")
    upto = F.sum("length").over(Window.partitionBy("klass", "bin").orderBy("place"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = written(placed, "placed")
    regular = placed.where(full).select(
        *columns, (F.col("bin") * SPAN + F.col("klass")).cast("long").alias("sequence_id"), (upto - F.col("length")).cast("long").alias("offset")
    )
    schema = f"{', '.join(f'{c} {placed.schema[c].dataType.simpleString()}' for c in columns)}, sequence_id long, offset long"
    left = placed.where(~full).select(*columns).groupBy(F.lit(0).alias("one")).applyInPandas(
        lambda g: best_fit(capacity)(g)[[*columns, "sequence_id", "offset"]], schema
    )
    return regular.unionByName(left)
