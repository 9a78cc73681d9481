"""Placement of tuples on instances. Stored and probing rows of the same pair always meet on exactly one instance, whatever the strategy.

A placement adds `inst`, from 0 to n - 1; the probing side of a replicating strategy has a row for each instance that it visits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_hash(key: Column) -> Column:
    """31 bits and more of a hash that SQL engines agree on."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def home(key: Column, n: int) -> Column:
    return (key_hash(key) % n).cast("int")


def member(row_id: Column, m: int) -> Column:
    """Which of m a stored row goes to: by a hash of the row, so reruns agree."""
    return F.pmod(F.xxhash64(row_id), F.lit(m)).cast("int")


def by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.withColumn("inst", home(F.col(key), n))


def store_random(rows: DataFrame, row_id: str, n: int) -> DataFrame:
    return rows.withColumn("inst", member(F.col(row_id), n))


def probe_all(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("inst", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def groups(n: int, m: int) -> int:
    """Groups of m among n instances; the last may be short."""
    return -(-n // m)


def _group(key: Column, n: int, m: int) -> tuple[Column, Column]:
    """(first instance, size) of the key's group."""
    first = (key_hash(key) % groups(n, m) * m).cast("int")
    return first, F.least(F.lit(m), F.lit(n) - first).cast("int")


def store_grouped(rows: DataFrame, key: str, row_id: str, n: int, m: int) -> DataFrame:
    """To one member, by the row, of the key's group."""
    first, size = _group(F.col(key), n, m)
    return rows.withColumn("inst", (first + F.pmod(F.xxhash64(F.col(row_id)), size)).cast("int"))


def probe_grouped(rows: DataFrame, key: str, n: int, m: int) -> DataFrame:
    """To every member of the key's group."""
    first, size = _group(F.col(key), n, m)
    return rows.withColumn("inst", F.explode(F.sequence(first, first + size - 1)))


def latest_routes(routes: DataFrame) -> DataFrame:
    """relation, key, target: the newest of each, by version."""
    return routes.groupBy("relation", "key").agg(F.max_by("target", "version").alias("target"))


def by_routes(rows: DataFrame, key: str, routes: DataFrame, n: int, relation: str = "R", limit: int = 100_000, few: bool | None = None) -> DataFrame:
    """By hash, but for keys with a route. One table of the storing relation decides both for its stores and for the probes of them.

    The routes are broadcast if no more than `limit` are there, else joined by key. few: whether that is so, where the caller has counted them.
    """
    own = routes.where(F.col("relation") == relation).select(F.col("key").alias("_route_key"), F.col("target").alias("_target"))
    few = own.limit(limit + 1).count() <= limit if few is None else few
    joined = rows.join(F.broadcast(own) if few else own, F.col(key) == F.col("_route_key"), "left")
    return joined.withColumn("target", F.coalesce("_target", F.lit(-1))).withColumn("inst", F.when(F.col("target") >= 0, F.col("target")).otherwise(home(F.col(key), n)).cast("int")).drop("_route_key", "_target")


def deal(rows: DataFrame, n: int) -> DataFrame:
    """The rows in n partitions, each instance's in the one of its number; a join or aggregation by key and instance needs no further exchange."""
    return rows.repartitionById(n, "inst")


#: The partition of a row that is dealt by parts.
PART = "_part"


def deal_parts(rows: DataFrame, n: int, parts: int, *by: Column) -> DataFrame:
    """The rows in n * parts partitions with PART, the number of a row's own: each instance's rows lie in `parts` that follow one another, in one of them those with equal `by`."""
    part = F.col("inst") * parts + F.pmod(F.xxhash64(*by), F.lit(parts))
    return rows.withColumn(PART, part.cast("int")).repartitionById(n * parts, PART)


def number_rows(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `seq`, their place by `order` within their key's partition of the order; for tuples without a number of their own."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order)))


@dataclass(frozen=True)
class Placement:
    """Where rows lie among n instances: store adds `inst` to stored rows; probe adds it to probing rows, one for each instance that a row visits. Each pair of equal keys meets on exactly one instance."""

    n: int
    store: Callable[[DataFrame], DataFrame]
    probe: Callable[[DataFrame], DataFrame]


def hashed(n: int, key: str = "key") -> Placement:
    place = lambda rows: by_hash(rows, key, n)
    return Placement(n, place, place)


def replicated(n: int, row_id: str = "seq") -> Placement:
    return Placement(n, lambda rows: store_random(rows, row_id, n), lambda rows: probe_all(rows, n))


def grouped(n: int, m: int, row_id: str = "seq", key: str = "key") -> Placement:
    return Placement(n, lambda rows: store_grouped(rows, key, row_id, n, m), lambda rows: probe_grouped(rows, key, n, m))


def routed(n: int, routes: DataFrame, storing: str = "R", key: str = "key", few: bool | None = None) -> Placement:
    place = lambda rows: by_routes(rows, key, routes, n, storing, few=few).drop("target")
    return Placement(n, place, place)


def own(n: int, store: Callable[[Column, Column], Column], probe: Callable[[Column], Column], row_id: str = "seq", key: str = "key") -> Placement:
    """A caller's placement: store gives a stored row's instance by its key and row_id, probe the array of instances that a key's probes visit.

    Every stored row is checked on its way: its instance must be from 0 to n - 1, and exactly once among those that its key's probes visit, so that no pair is lost or made twice; the query fails otherwise. Rows without a key match nothing and aren't checked.
    """
    wrong = lambda rows_key, inst, visits: F.concat(F.lit("placement: key "), rows_key.cast("string"), F.lit(" is stored on "), F.coalesce(inst.cast("string"), F.lit("none")), F.lit(" and probed on "), F.coalesce(F.to_json(visits), F.lit("none")))

    def stored(rows: DataFrame) -> DataFrame:
        inst, visits = store(F.col(key), F.col(row_id)).cast("int"), probe(F.col(key)).cast("array<int>")
        once = F.size(F.filter(visits, lambda v: v == inst)) == 1
        fits = F.coalesce(once & inst.between(0, n - 1), F.lit(False))
        # Spark may look at the instance before it drops rows without a key.
        checked = F.when(F.col(key).isNull(), F.lit(None).cast("int")).when(fits, inst).otherwise(F.raise_error(wrong(F.col(key), inst, visits)).cast("int"))
        return rows.where(F.col(key).isNotNull()).withColumn("inst", checked)

    return Placement(n, stored, lambda rows: rows.withColumn("inst", F.explode(probe(F.col(key)).cast("array<int>"))))
