"""An ordered index's vocabulary over a DataFrame of (key, value): a key may have many values. Changes give a new DataFrame.

Lookups of a few constants are plain filters and aggregates. Lookups of many probes work in slices of the key order, cut where the keys are, so keys of any type and
distribution give even slices: a window within each slice, and one over the slices' own rows, of which there are as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidejoin.operators.shared import ranged


def put(index: DataFrame, more: DataFrame) -> DataFrame:
    return index.unionByName(more)


def get(index: DataFrame, probes: DataFrame) -> DataFrame:
    """key, values (ascending): of the probes' keys; null for absent ones."""
    found = index.join(probes.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("values"))
    return probes.select("key").join(found, "key", "left")


def contains(index: DataFrame, probes: DataFrame) -> DataFrame:
    there = index.select("key").distinct().withColumn("there", F.lit(True))
    return probes.select("key").join(there, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("there"))


def remove(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys.select("key"), "key", "left_anti")


def remove_values(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without one equal value for each row of `pairs`; a key without values is gone."""
    return index.select("key", "value").exceptAll(pairs.select("key", "value"))


def remove_min(index: DataFrame) -> DataFrame:
    return index.join(F.broadcast(index.agg(F.min("key").alias("_end"))), F.col("key") == F.col("_end"), "left_anti")


def remove_max(index: DataFrame) -> DataFrame:
    return index.join(F.broadcast(index.agg(F.max("key").alias("_end"))), F.col("key") == F.col("_end"), "left_anti")


def ends(index: DataFrame) -> DataFrame:
    """One row: min_key, max_key; null if empty."""
    return index.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def _nearest(index: DataFrame, probes: DataFrame, down: bool) -> DataFrame:
    """probe, found: each probe's nearest key, itself included."""
    keys = index.select(F.col("key").alias("at"), F.col("key").alias("k")).distinct()
    both = keys.select("at", "k", F.lit(0).alias("kind")).unionByName(probes.select(F.col("key").alias("at"), F.lit(None).cast(index.schema["key"].dataType).alias("k"), F.lit(1).alias("kind")))
    both = ranged(both, F.col("at"))
    order = (F.col("at"), F.col("kind")) if down else (F.desc("at"), F.col("kind"))
    near = F.last("k", ignorenulls=True).over(Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    slices = both.groupBy("slice").agg((F.max("k") if down else F.min("k")).alias("end"))
    step = Window.orderBy("slice" if down else F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.last("end", ignorenulls=True).over(step).alias("beyond"))
    out = both.withColumn("near", near).where("kind = 1").join(slices, "slice")
    return out.select(F.col("at").alias("key"), F.coalesce("near", "beyond").alias("found"))


def floor(index: DataFrame, probes: DataFrame) -> DataFrame:
    """key (of the probe), found: the largest key that isn't above it."""
    return _nearest(index, probes, True)


def ceiling(index: DataFrame, probes: DataFrame) -> DataFrame:
    """key (of the probe), found: the smallest key that isn't below it."""
    return _nearest(index, probes, False)


def ranks(index: DataFrame) -> DataFrame:
    """key, rank: how many keys are below it."""
    keys = ranged(index.select("key").distinct(), F.col("key"))
    counts = keys.groupBy("slice").agg(F.count("*").alias("here"))
    below = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("slice", F.coalesce(F.sum("here").over(below), F.lit(0)).alias("below"))
    within = F.row_number().over(Window.partitionBy("slice").orderBy("key")) - 1
    return keys.withColumn("within", within).join(counts, "slice").select("key", (F.col("below") + F.col("within")).cast("bigint").alias("rank"))


def select(index: DataFrame, places: DataFrame) -> DataFrame:
    """rank, key: the keys of the given ranks, from 0; null beyond the last."""
    return places.select("rank").join(ranks(index), "rank", "left").select("rank", "key")


def rank(index: DataFrame, probes: DataFrame) -> DataFrame:
    """key (of the probe), rank: how many keys are below it. Keys and probes are ordered together, once."""
    both = index.select("key", F.lit(1).alias("own")).distinct().unionAll(probes.select("key", F.lit(0)))
    parts = ranged(both, F.col("key"))
    before = lambda *order: F.coalesce(F.sum("own").over(Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = parts.groupBy("slice").agg(F.sum("own").alias("own"))
    below = F.coalesce(F.sum("own").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("slice", below.alias("below"))
    # A probe comes before the key that is equal to it.
    out = parts.withColumn("within", before("key", "own")).where("own = 0").join(counts, "slice")
    return out.select("key", (F.col("below") + F.col("within")).cast("bigint").alias("rank"))


def key_range(index: DataFrame, low, high) -> DataFrame:
    """The keys from low to high, both included, ascending."""
    return index.where(F.col("key").between(low, high)).select("key").distinct().orderBy("key")


def size(index: DataFrame, low=None, high=None) -> DataFrame:
    """One row: how many keys there are, from low to high if given."""
    rows = index if low is None else index.where(F.col("key").between(low, high))
    return rows.agg(F.countDistinct("key").cast("bigint").alias("size"))


def is_empty(index: DataFrame) -> bool:
    return index.isEmpty()


def in_order(index: DataFrame) -> DataFrame:
    return index.select("key", "value").orderBy("key", "value")
