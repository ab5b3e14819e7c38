"""Following lanes: only rows that changed, and the end of lanes that fell silent.

The state of a lane is its last row and when it was last active. It needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``), which keeps timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: statuses that end a lane; nothing is inferred about one of these
ENDED = ("done", "failed", "returned", "stopped")
SHOWN = "status string, last_text string, last_tool string, tokens long"
ROW = "session_id string, agent_id string, ts timestamp, status string, last_text string, last_tool string, tokens long, inferred boolean"


class LaneFollower(StatefulProcessor):
    """Emits a lane's row when what it shows differs from what was emitted last; after ``quiet`` seconds a running lane has returned."""

    def __init__(self, quiet: int):
        self.quiet = quiet * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, " + SHOWN)

    def _row(self, key: tuple, at: int, shown: tuple, inferred: bool) -> dict:
        status, text, tool, tokens = shown
        return {"session_id": key[0], "agent_id": key[1], "ts": pd.Timestamp(at, unit="ms"), "status": status, "last_text": text, "last_tool": tool, "tokens": tokens, "inferred": inferred}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.last.get()) if self.last.exists() else None
        batch = pd.concat(list(rows))
        batch["at"] = batch["ts"].astype("datetime64[ms]").astype("int64")
        # of rows of one instant the same counts, whatever order they came in
        newest = batch.sort_values(["at", "tokens", "status", "last_text", "last_tool"], na_position="first").iloc[-1]
        at, tokens = int(newest["at"]), newest["tokens"]
        shown = (*(None if pd.isna(newest[c]) else newest[c] for c in ("status", "last_text", "last_tool")), None if pd.isna(tokens) else int(tokens))
        if held and (at < held[0] or (at, *shown) == held):
            return  # a newer row has been shown, or this one
        self.last.update((at, *shown))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if shown[0] not in ENDED:
            self.handle.registerTimer(at + self.quiet)
        if not held or shown != held[1:]:
            yield pd.DataFrame([self._row(key, at, shown, False)])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, status, text, tool, tokens = tuple(self.last.get())
        if status not in ENDED and at + self.quiet <= expiredTimerInfo.getExpiryTimeInMs():
            shown = ("returned", text, tool, tokens)
            self.last.update((at, *shown))
            yield pd.DataFrame([self._row(key, at + self.quiet, shown, True)])

    def close(self) -> None:
        pass


def follow_lanes(stream: DataFrame, quiet: int = 600, late: str = "1 minute") -> DataFrame:
    """Changed rows of a stream of lane rows (session_id, agent_id, ts, status, last_text, last_tool, tokens), and ``inferred`` ends.

    Each trigger shows a lane once at most, by its newest row; a repeated row and one older than what was shown change nothing; rows later than ``late`` are dropped by the watermark.
    A lane silent for ``quiet`` seconds of event time, and not ended, gets a row ``returned``; if it goes on after that, so do its rows.
    """
    columns = [c.split()[0] for c in ROW.split(", ")][:-1]
    rows = stream.select(*columns).withWatermark("ts", late).withColumn("tokens", F.col("tokens").cast("long"))
    return rows.groupBy("session_id", "agent_id").transformWithStateInPandas(LaneFollower(quiet), outputStructType=ROW, outputMode="Append", timeMode="EventTime")
