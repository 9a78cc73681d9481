"""Joins of two relations R and S: by equality or comparison of any fields, within a time window, under any placement, each pair once and R first.

A relation here is a DataFrame with `key`, and, where a window or duplicates matter, `ts` and `seq`; other columns are its payload. Result columns end in _r and _s.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bands
from . import placement as P

OPERATORS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
#: Least partitions of an instance in a placed join; more if the session's shuffle partitions, dealt over the instances, are more.
PARTS = 16
STRATEGIES = ("hash", "random", "grouped", "routed")


def relation(rows: DataFrame, key: str | Column, seq: str | None = None, ts: str | Column | None = None, **payload: str) -> DataFrame:
    """The columns that a join needs: key, seq, ts, and the payload under its new names."""
    as_column = lambda c: c if isinstance(c, Column) else F.col(c)
    named = {"key": key} | ({"seq": seq} if seq is not None else {}) | ({"ts": ts} if ts is not None else {}) | payload
    return rows.select(*(as_column(c).alias(name) for name, c in named.items()))


def _sided(rows: DataFrame, side: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*(F.col(c) if c in keep else F.col(c).alias(f"{c}_{side}") for c in rows.columns))


def in_window(ts_r: Column, ts_s: Column, window_r: float, window_s: float) -> Column:
    """Whether S came no more than window_r seconds after R, nor more than window_s before; both ends count. Windows are in whole milliseconds."""
    ms = F.unix_micros(ts_s) - F.unix_micros(ts_r)
    return ms.between(-int(window_s * 1000) * 1000, int(window_r * 1000) * 1000)


def equi(r: DataFrame, s: DataFrame, hint: str | None = None) -> DataFrame:
    """Inner join on key, in which Spark picks the method; AQE splits skewed keys."""
    left, right = _sided(r, "r", ("key",)), _sided(s, "s", ("key",))
    return left.join(right.hint(hint) if hint else right, "key")


def windowed(r: DataFrame, s: DataFrame, window_r: float, window_s: float) -> DataFrame:
    """Equal keys within the window. Time is cut into steps as long as the window, so a key with a long history isn't paired with all of it."""
    own = lambda rows, side: F.struct(*(F.col(f"`{c}`").alias(f"{c}_{side}") for c in rows.columns if c != "key")).alias(side)
    left, right = (x.select("key", "step", own(rows, side)) for x, rows, side in zip(_stepped(r, s, window_r, window_s), (r, s), "rs"))
    return left.join(right, ["key", "step"]).where(in_window(F.col("r.ts_r"), F.col("s.ts_s"), window_r, window_s)).select("key", "r.*", "s.*")


def theta(r: DataFrame, s: DataFrame, op: str, window: tuple[float, float] | None = None, **options) -> DataFrame:
    """Pairs whose keys compare so, within the window if one is given: by order, see bands; equality is a plain join."""
    if op == "=" and window is None:
        left, right = _sided(r, "r"), _sided(s, "s")
        columns = options.get("columns")
        out = left.join(right, F.col("key_r") == F.col("key_s"))
        return out.select(*columns) if columns else out
    return bands.ordered_join(r, s, op, window, **options)


def _stepped(r: DataFrame, s: DataFrame, window_r: float, window_s: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with `step`, a time step that a pair within the window shares: R keeps its own, S goes to its neighbours too."""
    length = max(1, int(max(window_r, window_s) * 1000)) * 1000
    at = F.floor(F.unix_micros("ts") / F.lit(length)).cast("bigint")
    return r.withColumn("step", at), s.withColumn("step", F.explode(F.sequence(at - 1, at + 1)))


def _within(pairs: DataFrame, window: tuple[float, float] | None) -> DataFrame:
    return pairs.where(in_window(F.col("ts_r"), F.col("ts_s"), *window)).drop("step") if window else pairs


def placement_of(strategy: str, n: int = 8, m: int = 2, row_id: str = "seq", routes: DataFrame | None = None) -> P.Placement:
    """The placement that a strategy's name stands for."""
    if strategy == "routed" and routes is None:
        raise ValueError("a routed join needs routes")
    made = {"hash": lambda: P.hashed(n), "random": lambda: P.replicated(n, row_id), "grouped": lambda: P.grouped(n, m, row_id), "routed": lambda: P.routed(n, routes)}
    if strategy not in made:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return made[strategy]()


def placed(r: DataFrame, s: DataFrame, strategy: str | P.Placement = "hash", n: int = 8, m: int = 2, row_id: str = "seq", routes: DataFrame | None = None, small: int = 100_000, window: tuple[float, float] | None = None) -> DataFrame:
    """The equi-join with `inst`, the instance on which a pair meets; R is stored and S probes. Both sides are dealt so that each instance's rows are in partitions
    of its own, by key (and time step), and the join takes them there: one exchange a side. An instance is PARTS tasks or more, so a task's share falls with the shuffle partitions whatever n is; a key's rows on an instance stay in one task. strategy: one of STRATEGIES, or a placement of the caller's own.

    random: R's rows lie anywhere and S visits all instances. Where S has no more than `small` rows, that is a broadcast join. With a window a key's rows meet by time steps, as in `windowed`.
    """
    where = strategy if isinstance(strategy, P.Placement) else placement_of(strategy, n, m, row_id, routes)
    on = ["key", "inst"] + (["step"] if window else [])
    if window:
        r, s = _stepped(r, s, *window)
    stored = where.store(r)
    if strategy == "random" and s.limit(small + 1).count() <= small:
        few = [c for c in on if c != "inst"]
        return _within(_sided(stored, "r", (*on,)).join(F.broadcast(_sided(s, "s", (*few,))), few), window)
    # Equal keys have equal hashes in their common type only.
    key, parts = bands._common(r, s), max(PARTS, -(-int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")) // where.n))
    spread = [F.col("key").cast(key), *(F.col(c) for c in on if c == "step")]
    left, right = (_sided(P.deal_parts(x, where.n, parts, *spread), side, (*on, P.PART)) for x, side in ((stored, "r"), (where.probe(s), "s")))
    return _within(left.join(right, [*on, P.PART]).drop(P.PART), window)


def join(r: DataFrame, s: DataFrame, op: str = "=", window: tuple[float, float] | None = None, strategy: str | P.Placement = "hash", dedup: bool = False, ids: tuple[str, ...] = ("seq_r", "seq_s"), columns: tuple[str, ...] | None = None, **options) -> DataFrame:
    """Every qualifying pair once: the operator of `op`, inside the window if one is given, under the strategy. columns: those of the result, all if none are given; others aren't made."""
    if op not in OPERATORS:
        raise ValueError(f"no operator {op!r}; there are {', '.join(OPERATORS)}")
    if op != "=":
        out = theta(r, s, op, window, columns=columns and tuple(dict.fromkeys((*columns, *(ids if dedup else ())))))
    elif window and strategy == "hash":
        out = windowed(r, s, *window)
    elif strategy == "hash" and not options:
        out = equi(r, s)
    else:
        out = placed(r, s, strategy, window=window, **options)
    out = out.dropDuplicates(list(ids)) if dedup else out
    return out.select(*columns) if columns else out


def placed_sums(r: DataFrame, s: DataFrame, value: str, strategy: str | P.Placement = "hash", n: int = 8, m: int = 2, row_id: str = "seq", routes: DataFrame | None = None) -> DataFrame:
    """key, pairs, total: for each key, the pairs that `placed` makes and the sum of R's integers `value` over them (a decimal of 38 digits), as sums over its instances. No pair is made.

    An instance's rows of R and S with a key all pair up, so it has stored x probes pairs of the key, and each stored value counts once a probe. Both sides are summed by key and instance in the
    tasks that read them, so a key of which most rows are costs no more than any other; what is shuffled is a row for each key, instance and task.
    """
    where = strategy if isinstance(strategy, P.Placement) else placement_of(strategy, n, m, row_id, routes)
    by = lambda rows, *sums: rows.where("key IS NOT NULL").groupBy("key", "inst").agg(*sums)
    stored = by(where.store(r), F.count("*").alias("stored"), F.sum(F.col(value).cast("decimal(20,0)")).alias("sum"))
    probes = by(where.probe(s), F.count("*").alias("probes"))
    met = stored.join(probes, ["key", "inst"]).groupBy("key")
    return met.agg(F.sum(F.col("stored") * F.col("probes")).alias("pairs"), F.sum(F.col("sum") * F.col("probes").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"))


def count_by_instance(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("inst").agg(F.count("*").alias("pairs"))


def comparisons(stored: DataFrame, probes: DataFrame) -> DataFrame:
    """inst, comparisons that scanning all stored rows for each probe would make."""
    a = stored.groupBy("inst").agg(F.count("*").alias("stored"))
    b = probes.groupBy("inst").agg(F.count("*").alias("probes"))
    return a.join(b, "inst", "full").select("inst", (F.coalesce("stored", F.lit(0)) * F.coalesce("probes", F.lit(0))).alias("comparisons"))


def has_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is among `keys`."""
    return rows.join(keys.select("key"), "key", "left_semi")
