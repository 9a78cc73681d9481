"""F1 to F4: comparison joins within a window, where many rows have the same times."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidejoin.operators import bands
from tidejoin.streaming.engine import Engine

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def side(spark, copies, shift):
    """200 times, 1000 s each after the other, with so many rows at each."""
    rows = spark.range(200 * copies).select((F.col("id") * 7919 % 1000 + shift).alias("key"), F.col("id").alias("seq"), F.timestamp_millis(F.col("id") % 200 * 1_000_000).alias("ts"))
    return rows.repartition(2)


@pytest.mark.parametrize("op", [">", "!=", "<="])
def test_rows_in_tiles_grow_with_the_rows(spark, monkeypatch, op):
    """twenty times the rows in a window go to no more tiles each, and each pair comes once."""
    monkeypatch.setattr(bands, "SLICE_ROWS", 20)
    monkeypatch.setattr(bands, "LEAST_SLICES", 4)
    for copies in (2, 40):
        r, s = side(spark, copies, 0), side(spark, copies, 1)
        tiles = bands.tiled(r, s, op, (3000.0, 2000.0), columns=("seq_r", "seq_s"))
        assert tiles.count() <= 5 * 2 * 200 * copies
        compare = {">": F.col("key_r") > F.col("key_s"), "!=": F.col("key_r") != F.col("key_s"), "<=": F.col("key_r") <= F.col("key_s")}[op]
        named = [x.select(F.col("key").alias(f"key_{n}"), F.col("seq").alias(f"seq_{n}"), F.col("ts").alias(f"ts_{n}")) for x, n in ((r, "r"), (s, "s"))]
        gap = F.unix_millis("ts_s") - F.unix_millis("ts_r")
        plain = named[0].join(named[1], compare & gap.between(-2_000_000, 3_000_000)).select("seq_r", "seq_s")
        got = bands.pairs(tiles, op, (3000.0, 2000.0)).select("seq_r", "seq_s")
        sums = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("seq_r", "seq_s").cast("decimal(20,0)"))).first()
        assert sums(got) == sums(plain) and got.distinct().count() == got.count()


@pytest.mark.parametrize("op", ["=", "!=", ">", ">=", "<", "<="])
def test_only_pairs_are_looked_at(op):
    rng = np.random.default_rng(3)
    (kr, tr), (ks, ts) = ((rng.integers(0, 9, n), rng.integers(0, 500, n)) for n in (700, 900))
    found = bands.matches(op, kr, ks, tr, ts, 40, 90)
    assert found.looked == len(found.left) > 0


@pytest.mark.parametrize("op", ["=", "!=", ">", "<="])
def test_a_row_of_a_tile_stands_for_a_bounded_number_of_pairs(monkeypatch, op):
    """Python returns places, not pairs, and no row of them stands for more pairs than are held at once."""
    monkeypatch.setattr(bands, "BLOCK", 32)
    monkeypatch.setattr(bands, "AT_ONCE", 100)
    monkeypatch.setattr(bands, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    n, m = 300, 400
    key, t = rng.integers(0, 20, n + m), rng.integers(0, 1000, n + m)
    rows = lambda name, here: pa.StructArray.from_arrays([pa.array(np.arange(n + m))], names=[name], mask=pa.array(~here))
    left = rng.permutation(np.arange(n + m) < n)
    both = pa.RecordBatch.from_arrays([pa.array(key), pa.array(t), rows("a_r", left), rows("b_s", ~left)], names=["k", "t", "row_r", "row_s"])
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    types = T.StructType([T.StructField("a_r", longs), T.StructField("b_s", longs), T.StructField("start", ints), T.StructField("end", ints)])
    got = []
    for batch in bands._tile(op, (50, 80), types)(iter([both.slice(0, 333), both.slice(333)])):
        assert batch.num_rows <= 7
        for x in batch.to_pylist():
            assert len(x["b_s"]) <= 32 and sum(x["end"]) - sum(x["start"]) < 100 + 32
            got += [(a, b) for a, start, end in zip(x["a_r"], x["start"], x["end"]) for b in x["b_s"][start:end]]
    compare = {"=": np.equal, "!=": np.not_equal, ">": np.greater, "<=": np.less_equal}[op]
    i, j = np.flatnonzero(left), np.flatnonzero(~left)
    gap = t[j][None, :] - t[i][:, None]
    x, y = np.nonzero(compare(key[i][:, None], key[j][None, :]) & (gap >= -50) & (gap <= 80))
    assert sorted(got) == sorted(zip(i[x].tolist(), j[y].tolist()))


def test_results_of_a_comparison_are_kept_as_rows(spark, tmp_path):
    """what the engine writes grows with the tuples, not with the pairs; these come when the results are read, each once, by another engine too."""
    rows = [("R" if i % 2 else "S", i * 7919 % 50, i, T0 + timedelta(seconds=i // 20)) for i in range(1200)]
    options = {"op": ">", "window": (8.0, 5.0), "columns": ("seq_r", "seq_s"), "folder": str(tmp_path / "engine")}
    engine = Engine(spark, lateness=100.0, **options)
    for batch in range(3):
        engine.step(spark.createDataFrame(rows[400 * batch : 400 * batch + 400], "relation string, key long, seq long, ts timestamp"), batch)
    engine.step(spark.createDataFrame(rows[800:], "relation string, key long, seq long, ts timestamp"), 2)
    want = sorted((a[2], b[2]) for a in rows for b in rows if a[0] == "R" and b[0] == "S" and a[1] > b[1] and -5 <= (b[3] - a[3]).total_seconds() <= 8)
    assert sorted((x.seq_r, x.seq_s) for x in Engine(spark, **options).results().collect()) == want
    written = spark.read.parquet(f"{engine.folder}/results").count()
    assert written <= 4 * len(rows) < len(want) / 5
