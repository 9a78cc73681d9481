"""Stream-stream joins by Structured Streaming's own state: with a window it is evicted by watermarks, without one it keeps all history."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidejoin.operators.joins import _sided, in_window
from tidejoin.operators.shared import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, off the heap; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_files(rows: DataFrame, ts: str, files: int) -> str:
    """A folder with the rows in so many files by time, each written after those before it, so that a file source takes them in that order."""
    folder = shared_folder(rows.sparkSession, "files")
    first, last = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    step = ((last or 0) - (first or 0)) // files + 1
    for i in range(files):
        at = F.unix_micros(ts) - F.lit(first or 0)
        rows.where((at >= i * step) & (at < (i + 1) * step)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def closed(folder: str, marks: DataFrame, ts: str) -> str:
    """The folder with end marks after its files: rows as `marks` has them, far in the future, in two files one after the other. They pass the sources' filters and join with nothing, and their time moves the watermark beyond all that came before, so every interval is closed."""
    spark = marks.sparkSession
    last = spark.read.parquet(folder).agg(F.max(ts)).first()[0]
    for days in (1000, 2000):
        marks.withColumn(ts, F.lit(last) + F.expr(f"INTERVAL {days} DAYS")).coalesce(1).write.mode("append").parquet(folder)
    return folder


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of a Parquet table's files; the path, of a file or a folder, is given as a pattern, as the source takes a plain one for a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed(r: DataFrame, s: DataFrame, window_r: float, window_s: float, delay: str) -> DataFrame:
    """Inner interval join: S from window_s seconds before R to window_r after. Rows later than `delay` behind the newest are dropped; state is kept for the window and the delay."""
    left = _sided(r.withWatermark("ts", delay), "r")
    right = _sided(s.withWatermark("ts", delay), "s")
    ms = lambda x: f"INTERVAL {int(x * 1000)} MILLISECONDS"
    within = F.expr(f"ts_s >= ts_r - {ms(window_s)} AND ts_s <= ts_r + {ms(window_r)}")
    return left.join(right, (F.col("key_r") == F.col("key_s")) & within).withColumnRenamed("key_r", "key").drop("key_s")


def full_history(r: DataFrame, s: DataFrame) -> DataFrame:
    """Inner join with all that came before. Its state grows with the streams: set spark.sql.streaming.stateStore.providerClass to ROCKSDB."""
    left, right = _sided(r, "r"), _sided(s, "s")
    return left.join(right, F.col("key_r") == F.col("key_s")).withColumnRenamed("key_r", "key").drop("key_s")


def deduplicated(rows: DataFrame, ids: list[str], ts: str, delay: str) -> DataFrame:
    """Without repeats of the ids that come within the delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through a Parquet sink: its rows, read again."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, "sink"), shared_folder(spark, "state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
