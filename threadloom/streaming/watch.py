"""Following sessions as Structured Streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id string, change string, from_idx long, n_messages long"


def watch(messages: DataFrame) -> DataFrame:
    """Changes of a stream of messages (session_id, msg_idx): ``new`` sessions whole, ``updated`` ones by what was appended.

    The state of a session is one number, the messages seen; re-delivered messages change nothing.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        top = seen
        for batch in batches:
            top = max(top, int(batch["msg_idx"].max()) + 1)
        if top > seen:
            state.update((top,))
            yield pd.DataFrame({"session_id": [key[0]], "change": ["updated" if seen else "new"], "from_idx": [seen], "n_messages": [top - seen]})

    return messages.groupBy("session_id").applyInPandasWithState(follow, OUTPUT, "seen long", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame) -> DataFrame:
    """Gap-free progress of numbered packs (producer, epoch, seq) that may come late or twice: (producer, epoch, frontier, waiting).

    The state keeps the frontier and the numbers beyond it that wait for a gap to close.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frontier, waiting = state.get if state.exists else (0, [])
        held = set(waiting)
        for batch in batches:
            held |= {int(s) for s in batch["seq"] if s > frontier}
        while frontier + 1 in held:
            frontier += 1
            held.discard(frontier)
        state.update((frontier, sorted(held)))
        yield pd.DataFrame({"producer": [key[0]], "epoch": [key[1]], "frontier": [frontier], "waiting": [len(held)]})

    output = "producer string, epoch string, frontier long, waiting long"
    return stream.groupBy("producer", "epoch").applyInPandasWithState(advance, output, "frontier long, waiting array<long>", "update", GroupStateTimeout.NoTimeout)


def first_deliveries(stream: DataFrame, key: str, when: str, late: str = "1 hour") -> DataFrame:
    """The first delivery of each key; the watermark bounds the state."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark([key])


def session_windows(stream: DataFrame, when: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """An addition: activity windows of each user that end after a quiet ``gap``."""
    w = F.session_window(when, gap)
    counted = stream.withWatermark(when, late).groupBy(w, "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def merged(current: DataFrame, batch: DataFrame, key: str = "session_id", at: str = "msg_idx") -> DataFrame:
    """A table after a batch: from each session's first index in the batch on, the batch's rows stand for the old ones."""
    first = batch.groupBy(key).agg(F.min(at).alias("_first"))
    kept = current.join(first, key, "left").where(F.col("_first").isNull() | (F.col(at) < F.col("_first"))).drop("_first")
    return kept.unionByName(batch)


def encoded_cursor(session: Column, kind: Column, mark: Column) -> Column:
    """A follower's mark as text: version, session, ``m`` for messages or ``b`` for bytes, count."""
    return F.concat_ws(":", F.lit("1"), F.base64(session.cast("binary")), kind, mark.cast("string"))


def decoded_cursor(text: Column) -> Column:
    """struct(session, kind, mark) of a cursor; null for another version or a broken one."""
    parts = F.split(text, ":")
    right = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "1") & F.get(parts, F.lit(2)).isin("m", "b") & F.get(parts, F.lit(3)).rlike("^[0-9]{1,18}$")
    held = F.struct(F.unbase64(F.get(parts, F.lit(1))).cast("string").alias("session"), F.get(parts, F.lit(2)).alias("kind"), F.get(parts, F.lit(3)).try_cast("long").alias("mark"))
    return F.when(right, held)
