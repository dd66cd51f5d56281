"""Streams: import in micro-batches, latest request wins, edits coalesced by a gap in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fotolake.operators.planning import new_files


def import_stream(files: DataFrame, known: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of a file listing (path, size): files not yet known are written; `known` is read anew each time.

    Bound a batch at the source, with maxFilesPerTrigger; a batch that is run again finds its rows known.
    """

    def step(batch: DataFrame, number: int) -> None:
        write(new_files(batch.dropDuplicates(["path"]), known()), number)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_wins(requests: DataFrame, slot: str, order: str, write: Callable[[DataFrame, int], None], checkpoint: str, known: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """The last request of each slot; stale ones are dropped before any work: those of a micro-batch, and those no later than what `known` (slot, order) says is written."""

    def step(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != slot]
        last = batch.groupBy(slot).agg(F.max_by(F.struct(*rest), order).alias("r")).select(slot, "r.*")
        if known is not None:
            done = known().groupBy(slot).agg(F.max(order).alias("__done"))
            last = last.join(done, slot, "left").where(F.col("__done").isNull() | (F.col(order) > F.col("__done")))
        write(last.select(batch.columns), number)

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Coalescer(StatefulProcessor):
    """Holds a key's open edit; another label, or a gap, sends it out and opens the next.

    An edit that nothing follows is sent once the watermark is past its gap. Rows late beyond the watermark are dropped by the
    engine, like any late data.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "id long, label string, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows))
        edits = sorted(zip((pdf["ts"].astype("int64") // 10**6 if pdf["ts"].dtype == "datetime64[ns]" else pdf["ts"].astype("datetime64[ms]").astype("int64")).tolist(), pdf["id"].tolist(), pdf["label"].tolist(), strict=True))
        held, out = self.open.get() if self.open.exists() else None, []
        for ms, ident, label in edits:
            if held is not None and not (held[1] == label and ms - held[2] < self.gap):
                out.append((key[0], int(held[0]), held[1], int(held[2])))
            held = (ident, label, ms)
        self.open.update(held)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(held[2]) + self.gap)
        yield pd.DataFrame(out, columns=["key", "id", "label", "ms"]).astype({"id": "int64", "ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.open.get()
        self.open.clear()
        yield pd.DataFrame([(key[0], int(held[0]), held[1], int(held[2]))], columns=["key", "id", "label", "ms"])

    def close(self) -> None:
        pass


def coalesce_edits(edits: DataFrame, key: str, gap_ms: int = 600, late: str = "10 seconds") -> DataFrame:
    """(key long, id, label, ms) of a stream (key, id, label, ts): the stream's form of the catalogue's coalesced log.

    Needs the RocksDB state store provider in the session.
    """
    rows = edits.select(F.col(key).cast("long").alias("key"), F.col("id").cast("long").alias("id"), "label", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Coalescer(gap_ms), "key long, id long, label string, ms long", "append", "eventtime")


def gap_sessions(events: DataFrame, key: str, time: str, gap: str, late: str = "1 minute") -> DataFrame:
    """Sessions of a key by a gap, the stream's form of stacks by time: (key, start, end, n)."""
    by = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return by.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
