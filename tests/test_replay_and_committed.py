"""The replayed source over restarts, and the sink with aborted and repeated writes."""

import pytest
from pyspark.sql import functions as F

from tidejoin.operators import files
from tidejoin.sources import committed, replay


def by_batch(spark, out):
    return {b: spark.read.parquet(f"{out}/batch={b}").count() for b in files.batches(spark, out)}


@pytest.mark.parametrize("fluctuating", [False, True])
def test_each_row_once_over_restarts_at_the_rate(spark, tmp_path, fluctuating):
    rows = spark.range(0, 230, 1, 3).select((F.col("id") * 7 % 230).alias("key"), F.col("id").cast("string").alias("text"), F.timestamp_seconds("id").alias("ts"))
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    replay.prepare(rows, folder, F.col("key"), rows_per_file=40)
    stream = lambda: replay.replay(spark, folder, 500, fluctuating, seed=5)
    want, left, tick = [], 230, 0
    while left:
        want.append(min(left, replay.released(tick, 50, 5 if fluctuating else None)))
        left, tick = left - want[-1], tick + 1
    assert (len(set(want)) > 2) == fluctuating

    class Lost(Exception):
        pass

    def failing(batch, number):
        if number == 2:
            raise Lost
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream().writeStream.foreachBatch(failing).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
    with pytest.raises(Exception):
        query.processAllAvailable()
    query.stop()
    assert sorted(by_batch(spark, out)) == [0, 1]
    replay.run_all(stream(), out, state)
    got = by_batch(spark, out)
    assert [got[b] for b in sorted(got) if got[b]] == want
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == list(range(230))
    assert spark.read.parquet(out).select("key", "text", "ts").exceptAll(rows).isEmpty()
    # Batches follow the order of the keys.
    first = spark.read.parquet(f"{out}/batch=0").agg(F.max("key")).first()[0]
    assert first == want[0] - 1
    replay.run_all(stream(), out, state)
    assert spark.read.parquet(out).count() == 230


def lines(spark, path):
    return sorted(r.value for r in committed.committed(spark, path).collect())


def test_table_is_there_whole_or_not(spark, tmp_path):
    path, tee = str(tmp_path / "out"), str(tmp_path / "tee")
    rows = spark.range(0, 10, 1, 3).select(F.concat(F.lit("é "), F.col("id").cast("string")).alias("line"))
    committed.write(rows, path, tee)
    want = sorted(f"é {i}" for i in range(10))
    assert lines(spark, path) == lines(spark, tee) == want and committed.ended(spark, path)["lines"] == 10
    with pytest.raises(Exception, match="there already"):
        committed.write(rows, path)
    bad = rows.select(F.when(F.col("line") == "é 7", F.raise_error(F.lit("lost"))).otherwise(F.lit("new")).alias("line"))
    with pytest.raises(Exception, match="lost"):
        committed.write(bad, path, overwrite=True)
    assert lines(spark, path) == want and not [x for x in files.names(spark, str(tmp_path)) if "staging" in x]
    committed.write(rows.limit(2), path, overwrite=True)
    assert len(lines(spark, path)) == 2
    committed.write(rows.limit(0), str(tmp_path / "none"))
    assert lines(spark, str(tmp_path / "none")) == [] and committed.ended(spark, str(tmp_path / "none"))["lines"] == 0
    assert committed.ended(spark, str(tmp_path / "other")) is None


def test_batches_are_written_once(spark, tmp_path):
    source, path, tee, state = (str(tmp_path / x) for x in ("in", "out", "tee", "state"))
    add = lambda *xs: spark.createDataFrame([(x,) for x in xs], "value string").coalesce(1).write.mode("append").text(source)
    add("a", "b")
    stream = lambda: spark.readStream.text(source)
    committed.write_stream(stream(), path, state, tee).awaitTermination()
    # A batch that Spark repeats, as its own log lacks the commit, is there already.
    files.delete(spark, f"{state}/commits")
    add("c")
    committed.write_stream(stream(), path, state, tee).awaitTermination()
    assert lines(spark, path) == lines(spark, tee) == ["a", "b", "c"]
    # What has no end mark isn't read, and is written anew.
    last = max(x for x in files.names(spark, path) if x.startswith("batch="))
    files.delete(spark, f"{path}/{last}/{committed.END}")
    assert "c" not in lines(spark, path) and lines(spark, tee) == ["a", "b", "c"]
    assert not [x for x in files.names(spark, str(tmp_path)) if "staging" in x]
