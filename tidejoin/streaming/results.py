"""What follows a stream's join in the same query: aggregates of its results by time, profiles that all instances have reported, first sights of results. Operators with state stand one after another, each closed by the watermark that the one before lets through.

A result's time is that of S's tuple. What is emitted is final: an interval when the watermark has passed it, after which no row of it can come.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets of the ids of first sights, and the columns of a row's time in microseconds, of its ids as text and of its bucket.
BUCKETS = 256
AT, ID, BUCKET = "_at", "_id", "_bucket"


def aggregated(pairs: DataFrame, value: str, seconds: int, ts: str = "ts_s") -> DataFrame:
    """at, n, total, least, most of a value of the pairs in each interval."""
    out = pairs.groupBy(F.window(ts, f"{seconds} seconds")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("window.start").alias("at"), "n", "total", "least", "most")


def aligned_profiles(rows: DataFrame, seconds: int, n: int, delay: str) -> DataFrame:
    """at, tuples, stored, latency: sums over all n instances of the intervals that each of them has reported, of a stream with inst, stored, latency and ts.

    A first aggregate makes each instance's profile of an interval, the next one counts the profiles; both are closed by the same watermark.
    """
    at = F.window("ts", f"{seconds} seconds").alias("at")
    own = rows.withWatermark("ts", delay).groupBy(at, "inst").agg(F.count("*").alias("tuples"), F.count_if("stored").alias("stored"), F.sum("latency").alias("latency"))
    out = own.groupBy("at").agg(F.count("*").alias("reports"), F.sum("tuples").alias("tuples"), F.sum("stored").alias("stored"), F.sum("latency").alias("latency"))
    return out.where(F.col("reports") == n).select(F.col("at.start").alias("at"), "tuples", "stored", "latency")


def _let_through(codes: np.ndarray, at: np.ndarray, seen: np.ndarray, known: np.ndarray, bound: int) -> np.ndarray:
    """Which rows are let through: of each code the first by time, unless one is known, and again the first that comes later than `bound` after the last one. seen, the last by code where known, is brought up to date, and known too.

    In each round every code has its next row found by binary search, so there are as many rounds as a code has rows let through.
    """
    order = np.lexsort((at, codes))
    c, a = codes[order], at[order]
    times, rank = np.unique(a, return_inverse=True)
    width = len(times) + 1
    place = c * width + rank
    left = np.unique(c)
    first = np.zeros(len(at), bool)
    while len(left):
        after = np.where(known[left], np.searchsorted(times, seen[left] + bound, side="right"), 0)
        row = np.searchsorted(place, left * width + after)
        there = row < np.searchsorted(place, (left + 1) * width)
        left, row = left[there], row[there]
        first[order[row]] = True
        seen[left], known[left] = a[row], True
    return first


class FirstSight(StatefulProcessor):
    """Lets through the first row of each id, and again the first one that comes later than `bound` microseconds after the last that it let through. Its key is a bucket of ids, whose times lie in one
    Arrow table: a call handles all rows of a bucket, however many ids it has. A timer forgets the ids that no row can repeat any more."""

    def __init__(self, bound: int, columns: list[str]):
        self.bound, self.columns = bound, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ids binary, due long")

    def _read(self) -> tuple[pd.Series, np.ndarray, int | None]:
        """The ids, their times, and the time in milliseconds for which a timer is set."""
        if not self.seen.exists():
            return pd.Series([], dtype=object), np.zeros(0, np.int64), None
        blob, due = self.seen.get()
        table = pa.ipc.open_stream(blob).read_all()
        return table["id"].to_pandas(), table["at"].to_numpy(), due

    def _write(self, ids: pd.Series | np.ndarray, at: np.ndarray, due: int | None) -> None:
        if due is None:
            # Rows up to the bound after the last one are repeats; the watermark tells when no more of them come.
            due = (int(at.min()) + self.bound) // 1000 + 1
            self.handle.registerTimer(due)
        table, out = pa.table({"id": pa.array(ids, pa.string()), "at": at}), io.BytesIO()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        self.seen.update((out.getvalue(), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Spark renames columns that tuples can't have as fields, so names go by place.
        own = pd.concat(list(rows), ignore_index=True).set_axis([*self.columns, AT, ID, BUCKET], axis=1).sort_values(AT, kind="stable")
        old, before, due = self._read()
        codes, ids = pd.factorize(np.concatenate([old.to_numpy(object), own[ID].to_numpy(object)]))
        seen, known = np.zeros(len(ids), np.int64), np.arange(len(ids)) < len(old)
        seen[: len(old)] = before
        first = _let_through(codes[len(old) :], own[AT].to_numpy(np.int64), seen, known, self.bound)
        if first.any():
            self._write(ids, seen, due)
        yield own.loc[first, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, at, _ = self._read()
        alive = (at + self.bound) // 1000 >= timerValues.getCurrentWatermarkInMs()
        if alive.any():
            self._write(ids[alive], at[alive], None)
        else:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def _id_text(rows: DataFrame, ids: list[str]) -> Column:
    """Text that is equal for equal ids only: times whole, with their offset, and one zero."""
    kind = {f.name: f.dataType for f in rows.schema}
    parts = [(F.col(c) + F.lit(0).cast(kind[c]) if isinstance(kind[c], T.FractionalType) else F.col(c)).alias(c) for c in ids]
    return F.to_json(F.struct(*parts), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"})


def first_sights(rows: DataFrame, ids: list[str], seconds: float, ts: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows without those that repeat the ids no later than so many seconds after the row that stands for them; rows of a key count in the order of their time.

    ts has a watermark. An id's state goes when the watermark has passed its bound, so there is state for the ids of that time only. It lies in so many buckets by a hash of the ids: Python is called for a bucket and batch, and a batch rewrites the buckets that it adds to.
    """
    # Longs that may be null go as a value and a mark: pandas would make them doubles.
    marked = {f.name: f"_null_{f.name}" for f in rows.schema if f.nullable and isinstance(f.dataType, T.LongType)}
    at = F.coalesce(F.unix_micros(ts), F.raise_error(F.lit("a row without a time")).cast("long"))
    out = rows.select("*", *(F.col(c).isNull().alias(mark) for c, mark in marked.items()), at.alias(AT), _id_text(rows, ids).alias(ID)).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in marked})
    types = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema if f.name not in (AT, ID)])
    bucketed = out.withColumn(BUCKET, F.pmod(F.xxhash64(ID), F.lit(buckets))).groupBy(BUCKET)
    found = bucketed.transformWithStateInPandas(FirstSight(int(seconds * 1e6), types.names), types, "Append", "EventTime")
    return found.select(*(F.when(~F.col(marked[c]), F.col(c)).alias(c) if c in marked else F.col(c) for c in rows.columns))
