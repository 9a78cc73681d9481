"""Profiles of join instances, their merge over all instances, and aggregates of results by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a stored tuple takes by itself, and in an index.
TUPLE_BYTES, INDEXED_BYTES = 64, 56


def profile(rows: DataFrame, seconds: int, ts: str = "ts", latency: str = "latency") -> DataFrame:
    """moment (its number), inst, tuples, throughput (a second), mean_latency, stored, probes; rows have inst, ts, latency and stored (whether they were stored)."""
    moment = F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")
    out = rows.groupBy(moment.alias("moment"), "inst").agg(
        F.count("*").alias("tuples"), F.sum(latency).alias("latency"), F.count_if("stored").alias("stored"), F.count_if(~F.col("stored")).alias("probes")
    )
    return out.withColumn("throughput", F.col("tuples") / F.lit(float(seconds))).withColumn("mean_latency", F.col("latency") / F.col("tuples"))


def aligned(profiles: DataFrame, n: int) -> DataFrame:
    """A row for each moment that all n instances have reported: throughput = tuples / duration (ms) * 1000 * n, latency = latencies / tuples, both 0 where they divide by 0, and sums of the rest."""
    sums = [F.sum(c).alias(c) for c in ("tuples", "duration", "latency", "comparisons", "migrations", "migrated", "results") if c in profiles.columns]
    out = profiles.groupBy("moment").agg(*sums, F.countDistinct("inst").alias("n")).where(F.col("n") == n).drop("n")
    zero = lambda x, by: F.when(F.col(by) == 0, 0.0).otherwise(F.col(x) / F.nullif(by, F.lit(0)))
    return out.withColumn("throughput", zero("tuples", "duration") * 1000 * n).withColumn("mean_latency", zero("latency", "tuples"))


def report_line(moment: Column, throughput: Column, latency: Column) -> Column:
    return F.format_string("@ [%d sec], %.2f, %.8f", moment, throughput, latency)


def spaced(lines: DataFrame, least: int) -> DataFrame:
    """At most one report in each `least` moments: the first of each."""
    return lines.groupBy(F.floor(F.col("moment") / least).alias("_slot")).agg(F.min_by(F.struct(*lines.columns), "moment").alias("row")).select("row.*")


def result_aggregate(results: DataFrame, value: str, seconds: int, ts: str = "ts") -> DataFrame:
    """at, count, sum, min, max of a value of the results in each interval."""
    return results.groupBy(F.window(ts, f"{seconds} seconds")["start"].alias("at")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def result_latency(now: Column, ts_r: Column, ts_s: Column) -> Column:
    """Seconds from the later tuple to now."""
    return (F.unix_micros(now) - F.unix_micros(F.greatest(ts_r, ts_s))) / 1e6


def in_window_count(rows: DataFrame, at: Column, seconds: float, ts: str = "ts") -> DataFrame:
    """One row: tuples no more than so many seconds before `at`, and the bytes that they take."""
    age = F.unix_micros(at) - F.unix_micros(ts)
    return rows.where(age.between(0, int(seconds * 1e6))).agg(F.count("*").alias("n"), (F.count("*") * TUPLE_BYTES).alias("bytes"))
