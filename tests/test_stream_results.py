"""First sights, closed intervals and observed counts of small streams."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidejoin.streaming import joins as streams
from tidejoin.streaming import observed, results

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
TYPES = "id long, ts timestamp"


def add(spark, folder, rows):
    spark.createDataFrame([(i, T0 + timedelta(seconds=t)) for i, t in rows], TYPES).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return streams.read_files(spark, folder, spark.createDataFrame([], TYPES).schema)


def test_first_sights(spark, tmp_path):
    """Batches in the order of time, repeats within and beyond the bound, over batches; ends of the bound count as repeats."""
    rng, folder = random.Random(1), str(tmp_path / "in")
    rows = sorted([(rng.randrange(6), rng.randrange(0, 400)) for _ in range(90)] + [(9, 0), (9, 30), (9, 61)], key=lambda x: x[1])
    for at in range(0, len(rows), 31):
        add(spark, folder, rows[at : at + 31])
    want, seen = [], {}
    for i, t in rows:
        if i not in seen or t > seen[i] + 30:
            want.append((i, t))
            seen[i] = t
    with streams.rocksdb(spark):
        out = streams.run_available(results.first_sights(stream(spark, folder).withWatermark("ts", "10 seconds"), ["id"], 30, "ts"))
    assert sorted((r.id, int((r.ts.replace(tzinfo=timezone.utc) - T0).total_seconds())) for r in out.collect()) == sorted(want)
    assert (9, 30) not in want and (9, 61) in want


def test_state_of_first_sights_goes(spark, tmp_path):
    folder = str(tmp_path / "in")
    for start in range(0, 4000, 1000):
        add(spark, folder, [(start + i, start) for i in range(50)])
    rows = results.first_sights(stream(spark, folder).withWatermark("ts", "10 seconds"), ["id"], 30, "ts")
    with streams.rocksdb(spark):
        seen = observed.run(rows, lambda w: w.format("noop").option("checkpointLocation", str(tmp_path / "state")).start(), F.count(F.lit(1)).alias("n"))
    assert sum(x["n"] for x in seen) == 200
    # The keys of the last two batches at most, each with its time and its timer.
    assert seen[-1]["state_rows"] <= 2 * 50 * 6


def test_end_marks_close_every_interval(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [(1, 5), (1, 15)])
    add(spark, folder, [(2, 25)])
    count = lambda: sorted(tuple(r) for r in streams.run_available(results.aggregated(stream(spark, folder).withWatermark("ts", "1 second"), "id", 10, "ts").where(F.year("at") == 2024)).select("n", "total").collect())
    assert len(count()) < 3
    streams.closed(folder, spark.createDataFrame([(-1,)], "id long").select("id", F.lit(None).cast("timestamp").alias("ts")), "ts")
    assert count() == [(1, 1), (1, 1), (1, 2)]


def test_observed_counts_are_those_of_the_batches(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    add(spark, folder, [(i, i) for i in range(7)])
    add(spark, folder, [(i, i) for i in range(3)])
    start = lambda w: w.format("noop").option("checkpointLocation", state).start()
    counts = (F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    rows = observed.run(stream(spark, folder), start, *counts)
    assert [(x["batch"], x["n"], x["ids"], x["read"]) for x in rows if x["read"]] == [(0, 7, 21, 7), (1, 3, 3, 3)]
    add(spark, folder, [(50, 1)])
    rows = observed.run(stream(spark, folder), start, *counts)
    assert [(x["batch"], x["n"], x["ids"]) for x in rows if x["read"]] == [(2, 1, 50)]
