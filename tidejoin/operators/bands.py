"""Comparison joins by order: pairs whose keys compare so, within a time window if one is given, without a look at pairs that can't match.

Each side is cut once into slices in the order of time and key (of key alone without a window); a slice is known by its least and largest time and key. Slices of both
sides that may hold a pair make a tile; those that are too far apart in time, or whose keys all compare the other way, make none. A slice has about the rows of one window, some thousands at
least and MOST_ROWS at most, so a row goes to few tiles however dense the times are, and what is shuffled grows with the rows.

In a tile S lies in the order of time, in blocks of 1, 2, 4 and so on rows, each ordered by key. The rows within a window are a few whole blocks, and in a block those that compare so are one run
(two for !=), found by binary search. A tile returns the runs, some thousands of pairs a row; Spark spreads them out into pairs, a row after the other, so no task holds the pairs of a tile.

So what is looked at grows with the rows and the answer, whatever the keys and times; equal times and keys are cut apart by a hash of the row, so slices are even.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidejoin.operators.shared import kept

#: Rows of a slice, at least and at most: a tile has the square of the latter in pairs, and holds no more rows than two slices.
SLICE_ROWS = 3000
MOST_ROWS = 50_000
#: Slices that a side has at least, if it has rows enough.
LEAST_SLICES = 16
#: Most tasks that tiles are dealt to, and most tiles whose numbers are broadcast.
MOST_TASKS = 2000
FEW_TILES = 100_000
#: Rows of the largest block of S in a tile, a power of two; pairs that a row of a tile's result stands for (more by a block at most), as Spark holds these at once; such rows in a batch.
BLOCK = 2048
AT_ONCE = 65_536
ROWS_AT_ONCE = 64
#: Pairs that `matches` spreads out at a time.
PIECE = 1_000_000
ROW_BITS = (1 << 33) - 1


@dataclass
class Runs:
    """`order` has places of S; row own[x] of R matches those from start[x] to end[x], which isn't among them. No run is empty."""

    order: np.ndarray
    own: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Matches:
    """Rows of both sides that match, by place, and how many pairs were looked at for it."""

    left: np.ndarray
    right: np.ndarray
    looked: int


def _runs(op: str, r: np.ndarray, width: int, order: np.ndarray, block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of R, the runs [from, to) of the ordered S, in the block given, whose keys compare so. Keys are ranks below `width`, and `order` has block * width + rank, ascending."""
    base = block * width
    at = lambda x, side: np.searchsorted(order, x, side=side)
    first, last = at(base, "left"), at(base + width, "left")
    below, upto = at(base + r, "left"), at(base + r, "right")
    return {"=": [(below, upto)], "!=": [(first, below), (upto, last)], ">": [(first, below)], ">=": [(first, upto)], "<": [(upto, last)], "<=": [(below, last)]}[op]


def runs(op: str, key_r: np.ndarray, key_s: np.ndarray, ts_r: np.ndarray | None = None, ts_s: np.ndarray | None = None, before: int = 0, after: int = 0) -> Iterator[Runs]:
    """All pairs with key_r `op` key_s and, if times are given, ts_s from ts_r - before to ts_r + after; each once, as runs that cross no multiple of BLOCK."""
    n, m = len(key_r), len(key_s)
    if not n or not m:
        return
    both, rank = np.unique(np.concatenate([key_r, key_s]), return_inverse=True)
    width, r, s = len(both), rank[:n].astype(np.int64), rank[n:].astype(np.int64)
    first = np.argsort(s if ts_r is None else ts_s, kind="stable")
    s, times = s[first], None if ts_r is None else ts_s[first]
    # The blocks [low, high) of a size that lie in the window of a row of R: those at either end that have no neighbour to make a block of twice the size with are taken, the others are merged.
    low, high = (np.zeros(n, np.int64), np.full(n, m)) if times is None else (np.searchsorted(times, ts_r - before, side="left"), np.searchsorted(times, ts_r + after, side="right"))
    order, size = np.arange(m), 1
    while (some := low < high).any():
        if size < BLOCK:
            odd, last = np.flatnonzero(some & (low % 2 == 1)), np.flatnonzero(some & (high % 2 == 1))
            own, block = np.concatenate([odd, last]), np.concatenate([low[odd], high[last] - 1])
            low, high = (low + 1) // 2, high // 2
        else:
            length = np.where(some, high - low, 0)
            own = np.repeat(np.arange(n), length)
            block = np.arange(len(own)) - np.repeat(np.cumsum(length) - length - low, length)
            high = low
        if len(own):
            code = order // size * width + s[order]
            # Halves are in order already, so this merges them.
            sort = np.argsort(code, kind="stable")
            order, code = order[sort], code[sort]
            for start, end in _runs(op, r[own], width, code, block):
                there = np.flatnonzero(end > start)
                if len(there):
                    yield Runs(first[order], own[there], start[there], end[there])
        size *= 2


def matches(op: str, key_r: np.ndarray, key_s: np.ndarray, ts_r: np.ndarray | None = None, ts_s: np.ndarray | None = None, before: int = 0, after: int = 0, piece: int = PIECE) -> Matches:
    """The pairs of `runs` by place, spread out in pieces."""
    left, right, looked = [], [], 0
    for x in runs(op, key_r, key_s, ts_r, ts_s, before, after):
        length = x.end - x.start
        ends = np.cumsum(length)
        looked += int(ends[-1])
        i = 0
        while i < len(length):
            # As many runs as fill a piece, one at least.
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + piece, side="right")))
            offset = np.arange(ends[j - 1] - done) - np.repeat(ends[i:j] - length[i:j] - done, length[i:j])
            left.append(np.repeat(x.own[i:j], length[i:j]))
            right.append(x.order[np.repeat(x.start[i:j], length[i:j]) + offset])
            i = j
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return Matches(join(left), join(right), looked)


def _common(r: DataFrame, s: DataFrame) -> T.DataType:
    """The type in which both keys are compared, as a union of them has it."""
    return r.select("key").union(s.select("key")).schema["key"].dataType


def sliced(rows: DataFrame, side: str, key: T.DataType, timed: bool, rows_per_slice: int, columns: tuple[str, ...] | None = None) -> DataFrame:
    """row (all columns or those of `columns`, named by side), k, t (microseconds; 0 without a window), slice; rows without a key or a time can't match and go."""
    names = [c for c in rows.columns if columns and f"{c}_{side}" in columns] or rows.columns
    whole = F.struct(*(F.col(f"`{c}`").alias(f"{c}_{side}") for c in names)).alias("row")
    t = F.unix_micros("ts") if timed else F.lit(0).cast("long")
    out = rows.select(whole, F.col("key").cast(key).alias("k"), t.alias("t"), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).alias("h")).where("k IS NOT NULL AND t IS NOT NULL")
    order = ["t", "k", "h"]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    within = F.col("n").bitwiseAND(F.lit(ROW_BITS).cast("long"))
    return kept(out.select("row", "k", "t", (F.col("n") - within % rows_per_slice).alias("slice")))


def zones(slices: DataFrame) -> DataFrame:
    """slice, k0, k1, t0, t1: least and largest key and time of each slice."""
    return slices.groupBy("slice").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def _may(op: str) -> Column:
    """Whether slices with these keys may hold a pair that compares so."""
    a0, a1, b0, b1 = (F.col(x) for x in ("r.k0", "r.k1", "s.k0", "s.k1"))
    both = (a0 <= b1) & (b0 <= a1)
    return {"=": both, "!=": ~((a0 == a1) & (b0 == b1) & (a0 == b0)), ">": a1 > b0, ">=": a1 >= b0, "<": a0 < b1, "<=": a0 <= b1}[op]


def near(zones_r: DataFrame, zones_s: DataFrame, op: str, window: tuple[int, int] | None) -> DataFrame:
    """i, j: slices of R and S that may hold a pair. window: microseconds before and after R's time.

    With a window the slices, which follow one another in time, meet on time steps that are as long as the window or as a slice is on average, so that each lies in few.
    """
    if window is None:
        return zones_r.alias("r").join(zones_s.alias("s"), _may(op)).select(F.col("r.slice").alias("i"), F.col("s.slice").alias("j"))
    before, after = window
    first, last, n = zones_r.agg(F.min("t0"), F.max("t1"), F.count("*")).first()
    step = max(before + after + 1, (last - first) // max(n, 1) + 1) if n else 1
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / step).cast("long"), F.floor(high / step).cast("long"))).alias("cell")
    left = zones_r.select("*", cells(F.col("t0"), F.col("t1"))).alias("r")
    right = zones_s.select("*", cells(F.col("t0") - after, F.col("t1") + before)).alias("s")
    meet = (F.col("r.cell") == F.col("s.cell")) & (F.col("s.t0") <= F.col("r.t1") + after) & (F.col("s.t1") >= F.col("r.t0") - before)
    return left.join(right, meet & _may(op)).select(F.col("r.slice").alias("i"), F.col("s.slice").alias("j")).distinct()


def _per_slice(r: DataFrame, s: DataFrame, window: tuple[int, int] | None) -> tuple[int, int]:
    """Rows of a slice of R and of S: as many as a row has within a window's length on average, or a share of the side, within bounds."""
    cell = F.floor(F.unix_micros("ts") / F.lit(sum(window) + 1)) if window else F.lit(0)
    cells = r.select(F.lit("r").alias("side"), cell.alias("cell")).unionAll(s.select(F.lit("s").alias("side"), cell.alias("cell")))
    n = F.col("n").cast("double")
    found = {x.side: (x.dense, x.n) for x in cells.groupBy("side", "cell").agg(F.count("*").alias("n")).groupBy("side").agg((F.sum(n * n) / F.sum(n)).alias("dense"), F.sum(n).alias("n")).collect()}
    return tuple(int(min(MOST_ROWS, max(SLICE_ROWS, min(dense, n / LEAST_SLICES)))) for dense, n in (found.get(x, (0, 0)) for x in "rs"))


def micros(window: tuple[float, float] | None) -> tuple[int, int] | None:
    """A window of R and S in seconds as microseconds before and after R's time."""
    return (int(window[1] * 1000) * 1000, int(window[0] * 1000) * 1000) if window else None


def tiled(r: DataFrame, s: DataFrame, op: str, window: tuple[float, float] | None = None, rows_per_slice: int | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """i, j, k, t, row_r, row_s: the rows of both sides, in the tiles (i, j) that may hold a pair of theirs; a row is of the side whose struct it has. `pairs` makes the pairs of it."""
    near_by = micros(window)
    key, sizes = _common(r, s), (rows_per_slice,) * 2 if rows_per_slice else _per_slice(r, s, near_by)
    left, right = (sliced(x, side, key, bool(window), size, columns) for x, side, size in ((r, "r", sizes[0]), (s, "s", sizes[1])))
    tiles = kept(near(zones(left), zones(right), op, near_by))
    met = F.broadcast(tiles) if tiles.count() <= FEW_TILES else tiles
    none = lambda rows: F.lit(None).cast(rows.schema["row"].dataType)
    # A slice goes to each of its tiles.
    mine = left.withColumnRenamed("slice", "i").join(met, "i").select("i", "j", "k", "t", F.col("row").alias("row_r"), none(right).alias("row_s"))
    other = right.withColumnRenamed("slice", "j").join(met, "j").select("i", "j", "k", "t", none(left).alias("row_r"), F.col("row").alias("row_s"))
    return mine.unionAll(other)


def _tile(op: str, window: tuple[int, int] | None, types: T.StructType):
    """For a tile's rows as `tiled` has them: rows with lists of the columns of R, of those of S, and of where R's rows start and end in those of S."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(types, timestamp_utc=True)

    def keys(column: pa.ChunkedArray) -> np.ndarray:
        return column.to_numpy() if not pa.types.is_boolean(column.type) else column.cast(pa.int8()).to_numpy()

    def lists(values: pa.Array, lengths: np.ndarray, to: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values.cast(to.value_type), type=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        left, right = (both.filter(both[row].is_valid()) for row in ("row_r", "row_s"))
        rows_r, rows_s = left["row_r"].combine_chunks(), right["row_s"].combine_chunks()
        times = (left["t"].to_numpy(), right["t"].to_numpy(), *window) if window else ()
        for found in runs(op, keys(left["k"]), keys(right["k"]), *times):
            # Runs by block, and in a block as many as make AT_ONCE pairs; of the block goes what they reach.
            sort = np.argsort(found.start, kind="stable")
            own, start, end = found.own[sort], found.start[sort], found.end[sort]
            block, share = start // BLOCK, np.cumsum(end - start) // AT_ONCE
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(block) > 0) | (np.diff(share) > 0), [True]]))
            for x in range(0, len(cuts) - 1, ROWS_AT_ONCE):
                ends = cuts[x : x + ROWS_AT_ONCE + 1]
                part, length = slice(ends[0], ends[-1]), np.diff(ends)
                low, high = start[ends[:-1]], np.maximum.reduceat(end[part], ends[:-1] - ends[0])
                places = found.order[np.concatenate([np.arange(*x) for x in zip(low, high)])]
                columns = [(c, length) for c in rows_r.take(pa.array(own[part])).flatten()] + [(c, high - low) for c in rows_s.take(pa.array(places)).flatten()]
                columns += [(pa.array(c[part] - np.repeat(low, length)), length) for c in (start, end)]
                yield pa.RecordBatch.from_arrays([lists(*c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def pairs(tiles: DataFrame, op: str, window: tuple[float, float] | None = None, by: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """The pairs of all tiles, each once: columns of both sides. by: what tells the tiles apart, if they are of more than one join. Python finds the runs, Spark spreads them out."""
    ours, theirs = ([*tiles.schema[row].dataType] for row in ("row_r", "row_s"))
    lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in (*ours, *theirs)] + [T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("start", "end")])
    # As many tasks as tiles, as a tile's pairs are far more than its rows.
    n = tiles.select(*by).distinct().count()
    found = tiles.repartition(max(1, min(n, MOST_TASKS)), *by).groupBy(*by).applyInArrow(_tile(op, micros(window), lists), lists)
    at = lambda name, place: F.get(f"`{name}`", F.col(place))
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.size("start") - 1)).alias("x"))
    found = found.select(*(at(f.name, "x").alias(f.name) for f in ours), *(F.col(f"`{f.name}`") for f in theirs), F.explode(F.sequence(at("start", "x"), at("end", "x") - 1)).alias("y"))
    return found.select(*(F.col(f"`{f.name}`") for f in ours), *(at(f.name, "y").alias(f.name) for f in theirs))


def ordered_join(r: DataFrame, s: DataFrame, op: str, window: tuple[float, float] | None = None, rows_per_slice: int | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Columns of both sides, named _r and _s, of each pair once: key_r `op` key_s and, with a window (of R and S in seconds, by `ts`), S at most so long after and before R. columns: those of the result, all if none are given; what isn't among them goes to no tile and into no pair."""
    out = pairs(tiled(r, s, op, window, rows_per_slice, columns), op, window)
    return out.select(*columns) if columns else out
