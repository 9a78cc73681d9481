"""Load of instances and its imbalance. An instance's load is its stored rows times the rows that probe it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 2.5


def parse_targets(text: Column) -> Column:
    """'[1, 2, 3]' as an array of integers."""
    inside = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.when(inside == "", F.array().cast("array<int>")).otherwise(F.split(inside, ",").cast("array<int>"))


def load_table(stored: DataFrame, probes: DataFrame) -> DataFrame:
    """inst, stored, probes, load; both inputs have inst. Rows are summed up before they are shuffled."""
    kinds = stored.select("inst", F.lit(1).alias("s"), F.lit(0).alias("p")).unionAll(probes.select("inst", F.lit(0), F.lit(1)))
    sums = kinds.groupBy("inst").agg(F.sum("s").cast("bigint").alias("stored"), F.sum("p").cast("bigint").alias("probes"))
    return sums.withColumn("load", F.col("stored") * F.col("probes"))


def all_instances(loads: DataFrame, n: int) -> DataFrame:
    """loads with rows of zeros for instances without rows."""
    every = loads.sparkSession.range(n).select(F.col("id").cast("int").alias("inst"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(loads, "inst", "left").select("inst", zero("stored"), zero("probes"), zero("load"))


def imbalance(loads: DataFrame) -> DataFrame:
    """One row: the most and least loaded instances (smaller numbers first in ties), their loads, and the ratio, null where the least is 0."""
    most = F.max(F.struct("load", (-F.col("inst")).alias("i"))).alias("most")
    least = F.min(F.struct("load", F.col("inst").alias("i"))).alias("least")
    row = loads.agg(most, least).select((-F.col("most.i")).alias("max_inst"), F.col("most.load").alias("max_load"), F.col("least.i").alias("min_inst"), F.col("least.load").alias("min_load"))
    return row.withColumn("imbalance", F.col("max_load") / F.nullif("min_load", F.lit(0)))


def triggered(balance: DataFrame, threshold: float = THRESHOLD, elapsed_ms: int | None = None, warm_up_ms: int = 5000) -> DataFrame:
    """The row of `imbalance`, if the ratio is above the threshold and the warm-up is over."""
    due = balance.where(F.col("imbalance") > threshold)
    return due if elapsed_ms is None or elapsed_ms > warm_up_ms else due.limit(0)


def load_log(stored: DataFrame, probes: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    """at (start of the interval), inst, stored, probes: rows of each interval."""
    at = F.window(ts, f"{seconds} seconds")["start"]
    kinds = stored.select("inst", at.alias("at"), F.lit(1).alias("s"), F.lit(0).alias("p")).unionAll(probes.select("inst", at.alias("at"), F.lit(0), F.lit(1)))
    return kinds.groupBy("at", "inst").agg(F.sum("s").cast("bigint").alias("stored"), F.sum("p").cast("bigint").alias("probes"))


def decayed(log: DataFrame, starts: Column) -> DataFrame:
    """inst, stored, probes after the last of the intervals `starts`: stored counts add up, and the probe counter is halved (in whole numbers) before each interval adds to it."""
    by_start = F.map_from_entries(F.collect_list(F.struct("at", F.struct("stored", "probes"))))
    own = log.groupBy("inst").agg(by_start.alias("seen"))
    value = lambda at, name: F.coalesce(F.try_element_at("seen", at)[name], F.lit(0)).cast("bigint")
    stored = F.aggregate(starts, F.lit(0).cast("bigint"), lambda acc, at: acc + value(at, "stored"))
    probes = F.aggregate(starts, F.lit(0).cast("bigint"), lambda acc, at: F.shiftright(acc, 1) + value(at, "probes"))
    return own.select("inst", stored.alias("stored"), probes.alias("probes"))


def both_monitors(r: DataFrame, s: DataFrame) -> DataFrame:
    """Loads of either relation's group: it stores its own rows and the other's probe it."""
    return load_table(r, s).withColumn("relation", F.lit("R")).unionByName(load_table(s, r).withColumn("relation", F.lit("S")))
