"""A modified Kneser-Ney model of code-point n-grams, one for each language, counted and estimated by Spark.

Tasks count the n-grams of their different texts; Spark sums them. Each lower order counts the
different grams one longer that end in a gram. Discounts come from the counts of counts
of a language and order, totals and back-off weights from the grams with one context, and
a gram's probability joins that of its suffix, order by order.

Since the model is of the texts that it scores, every n-gram of the highest order is known
and only that order is kept: (64-bit hash of language and gram, log probability), range-partitioned by
hash, sorted, and written as plain arrays to the shared folder. Tasks map these files into
memory where the folder is a mounted one and read them otherwise; the model may grow with the
corpus, and neither the driver nor a broadcast ever holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.arrays import MULTIPLIER, Texts, mix
from threadloom.llm.batches import give_back, only, slices
from threadloom.llm.marks import marks, slot, with_mark
from threadloom.session import folder, written

ORDER = 5
#: n-grams that a task merges at once, and those that it holds before it sends them on; entries in one file
MERGED, HELD, FILE_ENTRIES = 3 << 18, 1 << 19, 4_000_000
#: log probability of a gram that no text had
UNKNOWN = np.float32(np.log(1e-9))
#: bounds on a discount for counts of 1, 2, and 3 or more, and where counts of counts don't tell one
LEAST, MIDDLE = 0.05, 0.5


class Grams:
    """The n-gram that ends at each code point of a batch; a text begins with ``ORDER - 1`` empty places."""

    def __init__(self, texts: Texts, langs: pa.Array):
        points = np.frombuffer(texts.raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = texts.row_sums((texts.raw & 0xC0) != 0x80)
        self.rows = np.repeat(np.arange(texts.n), chars)
        self.at = np.arange(len(points)) + (ORDER - 1) * (self.rows + 1)
        self.points = np.zeros(len(points) + (ORDER - 1) * texts.n, np.uint32)
        self.points[self.at] = np.where(points == 0, np.uint32(0xFFFD), points)  # 0 is an empty place
        coded = langs.dictionary_encode() if not isinstance(langs, pa.ChunkedArray) else langs.combine_chunks().dictionary_encode()
        self.langs = [*coded.dictionary.to_pylist(), None]
        self.lang_of_row = np.asarray(coded.indices.fill_null(len(self.langs) - 1), np.int64)
        tags = Texts(pa.array([f"={x}" if x is not None else "" for x in self.langs], pa.string()))
        seed = tags.hashes(tags.at[:-1], tags.at[1:])
        total = np.zeros(len(points), np.uint64)
        for back in range(ORDER - 1, -1, -1):
            total = total * MULTIPLIER + self.points[self.at - back]
        self.keys = mix(total ^ seed[self.lang_of_row][self.rows]).view(np.int64)

    def of(self, places: np.ndarray) -> np.ndarray:
        """The code points of the grams at ``places``, one row each."""
        return np.stack([self.points[self.at[places] - back] for back in range(ORDER - 1, -1, -1)], axis=1)


class Counter:
    """Distinct keys with counts and grams, merged when many have come."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, grams: Grams) -> None:
        keys, first, n = np.unique(grams.keys, return_index=True, return_counts=True)
        names = pa.array(grams.langs, pa.string()).take(pa.array(grams.lang_of_row[grams.rows[first]]))
        self.parts.append((keys, n, grams.of(first), names))
        self.size += len(keys)
        if self.size > MERGED:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, first, same = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
            n = np.bincount(same, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
            names = pa.concat_arrays([p[3] for p in self.parts]).take(pa.array(first))
            self.parts = [(keys, n, np.concatenate([p[2] for p in self.parts])[first], names)]
            self.size = len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, n, grams, names in self.parts:
            for a in range(0, len(keys), 50_000):
                part = slice(a, a + 50_000)
                text = np.ascontiguousarray(grams[part]).view(f"<U{ORDER}").ravel()
                yield pa.RecordBatch.from_arrays(
                    [names[part], pa.array(text.tolist(), pa.string()), pa.array(keys[part]), pa.array(n[part].astype(np.int64))], names=["lang", "gram", "key", "n"]
                )
        self.parts, self.size = [], 0


def different_texts(docs: DataFrame) -> DataFrame:
    """(lang, text): each different text of a language once, so that copies don't weigh in the model.

    Texts are counted in hash slots; only those whose slot has more than one row are shuffled to
    be told apart, all others pass as they are.
    """
    found = docs.where("text IS NOT NULL").select("lang", "text", slot(F.col("lang"), F.col("text")).alias("_slot"))
    placed = with_mark(found, marks(found.groupBy("_slot").agg(F.count("*").alias("n")).where("n > 1")))
    once = placed.where("NOT _mark").select("lang", "text")
    shared = placed.where("_mark").groupBy("lang", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(F.first("text").alias("text"))
    return once.unionByName(shared.select("lang", "text"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, key, n) over all code points of the different texts, summed in each task before the shuffle; a gram starts with as many NULs as it has empty places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("grams")
        total = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                total.add(Grams(Texts(part.column("text")), part.column("lang")))
                if total.size > HELD and len(total.parts) == 1:
                    yield from total.rows()
        yield from total.rows()
        give_back()

    parts = different_texts(docs).mapInArrow(count, "lang string, gram string, key long, n long")
    return parts.groupBy("lang", "gram", "key").agg(F.sum("n").alias("n"))


def estimated(level: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """``level`` (lang, gram, n, ...) with ``p``, the interpolated probability of the gram's last place after the others."""
    of = [F.count_if(F.col("n") == i).alias(f"of_{i}") for i in (1, 2, 3, 4)]
    tallies = level.groupBy(F.col("lang").alias("of_lang")).agg(*of)
    y = F.col("of_1") / (F.col("of_1") + 2 * F.col("of_2"))
    known = (F.col("of_1") > 0) & (F.col("of_2") > 0) & (F.col("of_3") > 0)
    cuts = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * F.col(f"of_{i + 1}") / F.col(f"of_{i}")
        cuts.append(F.when(known, F.least(F.greatest(d, F.lit(LEAST)), F.lit(i - LEAST))).otherwise(F.lit(MIDDLE)).alias(f"d_{i}"))
    cuts = written(tallies.select("of_lang", *cuts), "discounts")  # one row for each language
    level = level.join(cuts, F.col("lang").eqNullSafe(F.col("of_lang")))
    level = level.withColumn("cut", F.when(F.col("n") == 1, F.col("d_1")).when(F.col("n") == 2, F.col("d_2")).otherwise(F.col("d_3")))
    # grams with one context: as many as there are different code points at most
    alike = Window.partitionBy("lang", F.substring("gram", 1, order - 1))
    level = level.withColumn("total", F.sum("n").over(alike)).withColumn("freed", F.sum("cut").over(alike))
    own = (F.col("n") - F.col("cut")) / F.col("total")
    if lower is None:
        under = 1 / (F.count(F.lit(1)).over(alike) + 1)
    else:
        below = lower.select(F.col("lang").alias("b_lang"), F.col("gram").alias("b_gram"), F.col("p").alias("under"))
        level = level.join(below, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.substring("gram", 2, order) == F.col("b_gram"))).drop("b_lang", "b_gram")
        under = F.col("under")
    return level.withColumn("p", own + F.col("freed") / F.col("total") * under).drop("of_lang", "d_1", "d_2", "d_3", "cut", "total", "freed", "under")


def probabilities(docs: DataFrame) -> DataFrame:
    """(lang, gram, key, n, p) of every n-gram of the highest order."""
    levels = [written(gram_counts(docs), "grams")]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[0].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n"))
        levels.insert(0, written(shorter, "grams"))
    found = None
    for order, level in enumerate(levels, 1):
        found = estimated(level, order, found)
    return found


class HashArrays:
    """Sorted (hash, log probability) arrays in files of the shared folder, one pair for each range of hashes."""

    def __init__(self, files: list[tuple[int, str, int]]):
        #: (least hash, path, entries), in order
        self.files = sorted(files)
        self.firsts = np.array([f[0] for f in self.files], np.int64)
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> list:
        return self.files

    def __setstate__(self, files: list) -> None:
        self.__init__(files)

    def arrays(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.opened:
            _, path, n = self.files[k]
            data = memoryview(buffer_of(path))
            self.opened[k] = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float32, n, 8 * n)
        return self.opened[k]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The log probability of each key."""
        asked, place = np.unique(keys, return_inverse=True)
        out = np.full(len(asked), UNKNOWN, np.float32)
        of = np.searchsorted(self.firsts, asked, "right") - 1
        for k in np.unique(of[of >= 0]):
            hashes, logs = self.arrays(int(k))
            mine = np.flatnonzero(of == k)
            at = np.minimum(np.searchsorted(hashes, asked[mine]), len(hashes) - 1)
            hit = hashes[at] == asked[mine]
            out[mine[hit]] = logs[at[hit]]
        return out[place]


def located(path: str) -> tuple[fs.FileSystem, str]:
    where, inner = fs.FileSystem.from_uri(path)
    return (fs.LocalFileSystem(use_mmap=True), inner) if isinstance(where, fs.LocalFileSystem) else (where, inner)


def buffer_of(path: str) -> pa.Buffer:
    where, inner = located(path)
    with where.open_input_file(inner) as f:
        return f.read_buffer()


def stored(table: DataFrame, where: str) -> HashArrays:
    """Writes ``table`` (key, log_p) as sorted arrays under ``where``; one row for each file reaches the driver."""
    located(where)[0].create_dir(located(where)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if got:
            keys = np.concatenate([b.column("key").to_numpy() for b in got])
            logs = np.concatenate([b.column("log_p").to_numpy() for b in got]).astype(np.float32)
            path = f"{where}/{TaskContext.get().partitionId():06d}"
            store, inner = located(path)
            attempt = f"{inner}.{uuid.uuid4().hex}"  # a task may run twice: the last whole file stands
            with store.open_output_stream(attempt) as f:
                f.write(keys.tobytes())
                f.write(logs.tobytes())
            store.move(attempt, inner)
            yield pa.record_batch({"least": keys[:1], "path": [path], "n": [len(keys)]})

    parts = max(1, -(-table.count() // FILE_ENTRIES))
    rows = table.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(write, "least long, path string, n long").collect()
    return HashArrays([tuple(r) for r in rows])


def fit(docs: DataFrame) -> HashArrays:
    """The models of all languages of ``docs`` (lang, text)."""
    found = written(probabilities(docs).select("key", F.log("p").cast("float").alias("log_p")), "model")
    return stored(found, folder(docs.sparkSession, "arrays"))
