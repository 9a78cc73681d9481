"""The load monitor on a live stream: counters of each instance in keyed state, halved by event-time timers at the end of each interval.

A micro-batch's rows are summed up by instance and interval in the tasks that read them, so an instance gets few rows from each task however hot it is. The state of an instance is its counters as of the last closed
interval, and a map of the intervals that the watermark hasn't passed. A timer at an interval's end folds it into the counters: stored rows add up, the probe counter is halved before the interval adds to it, and intervals
without rows halve it too. So rows of open intervals may come in any order, and the state of an instance has no more entries than the delay has intervals.

Every change is emitted as the counters after an interval (update mode), so the newest row of an instance is its load as of now; `current` reads it from the sink, with the halvings of intervals that have passed since.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidejoin.streaming.joins import rocksdb

SUMS = "inst int, slot long, stored long, probes long, seen timestamp"
OUT = "inst int, slot long, stored long, probes long, closed boolean"
NONE = -(2**62)


def sums(rows: DataFrame, seconds: int) -> DataFrame:
    """SUMS of each Arrow batch of rows (inst, stored (whether the row is), ts): slot is the number of the interval, seen the newest time in it."""
    micros = seconds * 1_000_000

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pandas()
            own["slot"] = own["at"] // micros
            out = own.groupby(["inst", "slot"], as_index=False).agg(stored=("stored", "sum"), probes=("probes", "sum"), seen=("at", "max"))
            columns = [pa.array(out["inst"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("slot", "stored", "probes")), pa.array(out["seen"], pa.int64()).cast(pa.timestamp("us", "UTC"))]
            yield pa.record_batch(columns, ["inst", "slot", "stored", "probes", "seen"])

    kind = F.col("stored").cast("long")
    return rows.where("ts IS NOT NULL AND inst IS NOT NULL").select(F.col("inst").cast("int").alias("inst"), F.unix_micros("ts").alias("at"), kind.alias("stored"), (1 - kind).alias("probes")).mapInArrow(add, SUMS)


class Load(StatefulProcessor):
    """Counters of one instance."""

    def __init__(self, seconds: int):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "slot long, stored long, probes long")
        self.open = handle.getMapState("open", "slot long", "stored long, probes long")

    def _base(self) -> tuple[int, int, int]:
        return tuple(self.base.get()) if self.base.exists() else (NONE, 0, 0)

    @staticmethod
    def folded(base: tuple[int, int, int], slots: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """The counters after each of the slots, which are in order."""
        at, stored, probes = base
        for slot, s, p in slots:
            stored, probes = stored + s, (probes >> min(slot - at, 63)) + p
            at = slot
            yield at, stored, probes

    def _open(self) -> list[tuple[int, int, int]]:
        return sorted((k[0], v[0], v[1]) for k, v in self.open.iterator())

    def _frame(self, key: int, rows: list[tuple[int, int, int]], closed: bool) -> pd.DataFrame:
        return pd.DataFrame([(key, *row, closed) for row in rows], columns=["inst", "slot", "stored", "probes", "closed"]).astype({"inst": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, base = timerValues.getCurrentWatermarkInMs(), self._base()
        for part in rows:
            for slot, s, p in part.groupby("slot")[["stored", "probes"]].sum().itertuples():
                slot, s, p = int(slot), int(s), int(p)
                # A slot that the watermark has passed, or that is folded already, is late.
                if (slot + 1) * self.ms <= mark or slot <= base[0]:
                    continue
                if self.open.containsKey((slot,)):
                    was = self.open.getValue((slot,))
                    s, p = s + was[0], p + was[1]
                else:
                    self.handle.registerTimer((slot + 1) * self.ms)
                self.open.updateValue((slot,), (s, p))
        out = list(self.folded(base, self._open()))
        if out:
            yield self._frame(key[0], out, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = expiredTimerInfo.getExpiryTimeInMs() // self.ms - 1
        closed = [x for x in self._open() if x[0] <= done]
        out = list(self.folded(self._base(), closed))
        for slot, *_ in closed:
            self.open.removeKey((slot,))
        if out:
            self.base.update(out[-1])
            yield self._frame(key[0], out, True)

    def close(self) -> None:
        pass


def live_load(rows: DataFrame, seconds: int, delay: str) -> DataFrame:
    """OUT rows of a stream (inst, stored, ts): an instance's counters after each interval that has changed, closed ones once more."""
    summed = sums(rows, seconds).withWatermark("seen", delay)
    return summed.groupBy("inst").transformWithStateInPandas(Load(seconds), OUT, "Update", "EventTime")


def write_batches(out: DataFrame, folder: str, checkpoint: str, **trigger):
    """The stream's batches in folders named by number, so a repeated batch replaces itself."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    with rocksdb(out.sparkSession):
        return out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """inst, stored, probes after the newest interval of any instance, from what `write_batches` has written."""
    seen = spark.read.option("basePath", folder).schema(f"{OUT}, batch long").parquet(folder)
    last = seen.groupBy("inst").agg(F.max_by(F.struct("slot", "stored", "probes"), F.struct("slot", "batch")).alias("c")).select("inst", "c.*")
    newest = last.agg(F.max("slot").alias("newest"))  # one row
    halved = F.call_function("shiftright", F.col("probes"), F.least(F.col("newest") - F.col("slot"), F.lit(63)).cast("int"))
    return last.join(F.broadcast(newest)).select("inst", "stored", halved.alias("probes"))
