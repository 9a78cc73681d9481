"""Comparison joins by order, against all pairs."""

import operator
import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidejoin.operators import bands, joins

PLAIN = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
sides = st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 60)), max_size=25)


@given(sides, sides, st.sampled_from(sorted(PLAIN)), st.integers(0, 9), st.integers(0, 9), st.integers(1, 9), st.booleans())
@settings(max_examples=300, deadline=None)
def test_matches(a, b, op, before, after, piece, timed):
    array = lambda xs, i: np.array([x[i] for x in xs], np.int64)
    times = (array(a, 1), array(b, 1), before, after) if timed else ()
    found = bands.matches(op, array(a, 0), array(b, 0), *times, piece=piece)
    want = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if PLAIN[op](x[0], y[0]) and (not timed or -before <= y[1] - x[1] <= after)]
    assert sorted(zip(found.left.tolist(), found.right.tolist())) == want


@pytest.mark.parametrize("op", [">", "<", "!=", "="])
def test_pairs_looked_at_grow_with_the_answer(op):
    rng = np.random.default_rng(1)
    for n in (500, 1000, 2000):
        # A key of which a third of all rows are, and times with as many rows at once.
        side = lambda n=n: (np.where(rng.random(n) < 0.3, 7, rng.integers(0, 50, n)), np.where(rng.random(n) < 0.3, 10**6, rng.integers(0, 10**7, n)))
        (kr, tr), (ks, ts) = side(), side()
        found = bands.matches(op, kr, ks, tr, ts, 5000, 8000)
        assert found.looked <= 3 * len(found.left) + 4 * n
        low, high = rng.integers(0, 100, n), rng.integers(100, 200, n)
        assert bands.matches(">", low, high).looked == 0 and bands.matches("=", low, high).looked == 0


def frame(spark, rows, types):
    return spark.createDataFrame([(k, i, None if ms is None else T0 + timedelta(milliseconds=ms), [i], {"a": i}) for i, (k, ms) in enumerate(rows)], f"key {types}, seq long, ts timestamp, list array<int>, inner struct<a:int>")


KEYS = {
    "int": lambda r: r.choice([None, *range(-5, 6)]),
    "double": lambda r: r.choice([None, -1.5, 0.0, 2.5, float("inf"), float("nan")]),
    "string": lambda r: r.choice([None, "", "a", "A", "é", "\U0001f600", "�"]),
    "decimal(10,2)": lambda r: r.choice([None, Decimal("1.10"), Decimal("-3.00"), Decimal("7.25")]),
    "boolean": lambda r: r.choice([None, True, False]),
    "date": lambda r: r.choice([None, T0.date(), T0.date() + timedelta(3)]),
}


@pytest.mark.parametrize("types", sorted(KEYS))
def test_keys_of_all_types(spark, types):
    """Null keys match nothing; the order is Spark's own, that of NaN and of text by bytes too."""
    rng = random.Random(2)
    r, s = (frame(spark, [(KEYS[types](rng), rng.choice([None, *range(0, 4000, 250)])) for _ in range(n)], types) for n in (40, 35))
    for op in (">", "<=", "!="):
        plain = r.crossJoin(s.select(*(F.col(c).alias(f"{c}_s") for c in s.columns))).where(PLAIN[op](F.col("key"), F.col("key_s")))
        got = bands.ordered_join(r, s, op, rows_per_slice=8)
        assert sorted((x.seq_r, x.seq_s) for x in got.collect()) == sorted((x.seq, x.seq_s) for x in plain.collect())
        near = plain.where(joins.in_window(F.col("ts"), F.col("ts_s"), 0.9, 0.5))
        got = bands.ordered_join(r, s, op, (0.9, 0.5), rows_per_slice=8)
        rows = got.collect()
        assert sorted((x.seq_r, x.seq_s) for x in rows) == sorted((x.seq, x.seq_s) for x in near.collect())
        assert all(x.list_r == [x.seq_r] and x.inner_s.a == x.seq_s and x.ts_r is not None for x in rows)


def test_different_types_and_empty_sides(spark):
    r = spark.createDataFrame([(1, 0), (5, 1)], "key int, seq long")
    s = spark.createDataFrame([(0.5, 0), (4.5, 1)], "key double, seq long")
    assert sorted((x.seq_r, x.seq_s) for x in joins.theta(r, s, ">").collect()) == [(0, 0), (1, 0), (1, 1)]
    assert joins.theta(r.limit(0), s, ">").count() == joins.theta(r, s.limit(0), "!=").count() == 0
    assert joins.theta(r, s, ">").columns == ["key_r", "seq_r", "key_s", "seq_s"]


def test_tiles_that_cannot_match_are_not_made(spark):
    rows = lambda n, shift: spark.range(n).select((F.col("id") * 7919 % 1000 + shift).alias("key"), F.col("id").alias("seq"), F.timestamp_millis(F.col("id") * 1000).alias("ts"))
    def tiles(r, s, op, window):
        left, right = (bands.sliced(x, side, r.schema["key"].dataType, window is not None, 100) for x, side in ((r, "r"), (s, "s")))
        return bands.near(bands.zones(left), bands.zones(right), op, window).collect(), left.select("slice").distinct().count()
    # A window of 10 s over 4000 s in slices of 100 s: a slice meets itself and its neighbours.
    found, slices = tiles(rows(4000, 0), rows(4000, 0), ">", (10**7, 10**7))
    assert slices <= 44 and len(found) <= 3.3 * slices + 8
    assert tiles(rows(2000, 0), rows(2000, 5000), ">", (10**7, 10**7))[0] == []
    # Without one, the half of the tiles where R is above S.
    found, slices = tiles(rows(2000, 0), rows(2000, 0), ">", None)
    assert len(found) <= 0.6 * slices**2 + slices
    plan = bands.near(*(bands.zones(bands.sliced(rows(1000, 0), x, rows(1, 0).schema["key"].dataType, True, 100)) for x in "rs"), ">", (10**6, 10**6))
    assert "Cartesian" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("strategy", ["hash", "random", "grouped", "routed"])
def test_windows_under_every_placement(spark, strategy):
    rng = random.Random(4)
    side = lambda n: [(rng.choice([7, 7, 1, 2]), rng.randrange(0, 50_000)) for _ in range(n)]
    a, b = side(60), side(80)
    r, s = (frame(spark, x, "long").select("key", "seq", "ts") for x in (a, b))
    extra = {"routes": spark.createDataFrame([("R", 7, 1)], "relation string, key long, target int")} if strategy == "routed" else {}
    for more in ({}, {"small": 0}) if strategy == "random" else ({},):
        out = joins.join(r, s, window=(3.0, 2.0), strategy=strategy, n=4, **extra, **more)
        assert sorted((x.seq_r, x.seq_s) for x in out.collect()) == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and -2000 <= y[1] - x[1] <= 3000)
        assert "step" not in out.columns
