"""The live load monitor against the same counters from tables."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidejoin.operators import monitor
from tidejoin.streaming import joins as streams
from tidejoin.streaming import monitor as live

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
TYPES = "inst int, stored boolean, ts timestamp"


def add(spark, folder, rows):
    """One more file: (instance, stored, second)."""
    spark.createDataFrame([(i, s, T0 + timedelta(seconds=t)) for i, s, t in rows], TYPES).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, seconds=10, delay="25 seconds"):
    rows = streams.read_files(spark, folder, spark.createDataFrame([], TYPES).schema)
    live.write_batches(live.live_load(rows, seconds, delay), out, f"{out}-state").awaitTermination()
    return sorted(tuple(r) for r in live.current(spark, out).collect())


def plain(spark, rows, seconds=10):
    frame = spark.createDataFrame([(i, s, T0 + timedelta(seconds=t)) for i, s, t in rows], TYPES)
    log = monitor.load_log(frame.where("stored"), frame.where("NOT stored"), seconds)
    last = max(t for *_, t in rows) // seconds
    starts = F.array(*(F.lit(T0 + timedelta(seconds=seconds * i)) for i in range(last + 1)))
    return sorted(tuple(r) for r in monitor.decayed(log, starts).collect())


def test_restart_out_of_order_and_late_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(0, True, 1), (0, False, 2), (1, False, 3), (0, False, 11), (2, True, 14)] + [(0, False, 5)] * 40
    second = [(1, False, 31), (0, False, 12), (1, True, 9), (0, False, 33)]  # two of them come after newer ones
    add(spark, folder, first)
    add(spark, folder, second)
    assert run(spark, folder, out) == plain(spark, first + second)
    third, late = [(0, False, 95), (2, False, 71)], [(0, False, 4), (1, True, 12)]
    add(spark, folder, third)
    assert run(spark, folder, out) == plain(spark, first + second + third)
    # The watermark is now at 70 seconds: what belongs to closed intervals is dropped, what doesn't counts.
    add(spark, folder, [*late, (1, False, 75)])
    assert run(spark, folder, out) == plain(spark, first + second + third + [(1, False, 75)])
    closed = spark.read.parquet(out).where("closed").groupBy("inst", "slot").count()
    assert closed.where("count > 1").count() == 0 and closed.count() >= 6
    # Nothing new: the same answer from what is there.
    assert run(spark, folder, out) == plain(spark, first + second + third + [(1, False, 75)])


def test_sums_go_to_the_state(spark):
    """However hot an instance, the shuffle gets a row for each of its intervals and Arrow batch."""
    rows = spark.range(0, 100_000, 1, 4).select(F.lit(3).alias("inst"), (F.col("id") % 4 == 0).alias("stored"), F.timestamp_seconds(F.col("id") % 20).alias("ts"))
    got = live.sums(rows, 10).groupBy("inst", "slot").agg(F.count("*").alias("n"), F.sum("stored").alias("s"), F.sum("probes").alias("p")).collect()
    assert {(r.slot, r.s, r.p) for r in got} == {(0, 15_000, 35_000), (1, 10_000, 40_000)} and all(r.n <= 16 for r in got)


def test_fold():
    assert list(live.Load.folded((live.NONE, 0, 0), [(5, 1, 7), (6, 0, 0), (8, 2, 1), (200, 0, 9)])) == [(5, 1, 7), (6, 1, 3), (8, 3, 1), (200, 3, 9)]
