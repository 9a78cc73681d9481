"""Sources: message streams, text files and generated tuples, and their translation to tagged tuples (relation, ts, key, value)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidejoin.functions import geo, scalars

LON_FIELD, LAT_FIELD = 3, 4


def kafka(spark: SparkSession, brokers: str, topics: dict[str, str], group: str | None = None, starting: str = "earliest", streaming: bool = True) -> DataFrame:
    """relation, topic, partition, offset, key, value of Kafka topics, {topic: relation}. Needs Spark's Kafka connector on the class path; offsets are kept in the query's checkpoint."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", brokers).option("subscribe", ",".join(topics)).option("startingOffsets", starting)
    reader = reader.option("failOnDataLoss", "false").option("kafka.retry.backoff.ms", "2").option("kafka.retry.backoff.max.ms", "10000")
    if group:
        reader = reader.option("kafka.group.id", group)
    rows = reader.load().select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp")
    return tagged(rows, topics)


def tagged(rows: DataFrame, topics: dict[str, str]) -> DataFrame:
    """Rows of known topics with their relation; others are left out."""
    relation = F.lit(None).cast("string")
    for topic, name in topics.items():
        relation = F.when(F.col("topic") == topic, name).otherwise(relation)
    return rows.withColumn("relation", relation).where("relation IS NOT NULL")


def topics_for(size: str, r: str = "orders", s: str = "tracks") -> dict[str, str]:
    """A topic for each relation, by data size."""
    return {f"{r}{size}": "R", f"{s}{size}": "S"}


def number_or_null(text: Column) -> Column:
    """A double; null for what is none."""
    return text.try_cast("double")


def geo_tuples(rows: DataFrame, precision: int = 7, value: str = "value", ts: Column | None = None) -> DataFrame:
    """relation, ts, key, value of comma-separated records: the key is the geohash of two fields. Records without two numbers there are left out."""
    fields = F.split(F.col(value), ",")
    lat, lon = (number_or_null(F.get(fields, F.lit(i))) for i in (LAT_FIELD, LON_FIELD))
    parsed = rows.withColumn("_lat", lat).withColumn("_lon", lon).where("_lat IS NOT NULL AND _lon IS NOT NULL")
    return parsed.select("relation", (ts if ts is not None else F.current_timestamp()).alias("ts"), geo.encode(F.col("_lat"), F.col("_lon"), precision).alias("key"), F.col(value).alias("value"))


def malformed(rows: DataFrame, value: str = "value") -> DataFrame:
    """One row: how many records geo_tuples leaves out."""
    fields = F.split(F.col(value), ",")
    bad = number_or_null(F.get(fields, F.lit(LAT_FIELD))).isNull() | number_or_null(F.get(fields, F.lit(LON_FIELD))).isNull()
    return rows.agg(F.count_if(bad).alias("malformed"))


def lines(spark: SparkSession, path: str | None) -> DataFrame:
    """`value`, a row per line; no rows if the path is missing or empty."""
    empty = spark.createDataFrame([], "value string")
    if not path:
        return empty
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise


def split_lines(spark: SparkSession, path: str | None, punctuation: str = "") -> DataFrame:
    return lines(spark, path).select(scalars.split_fields(F.col("value"), punctuation).alias("fields"))


def random_tuples(spark: SparkSession, rows: int, relation: str | None = None, ints=(0, 20000), doubles=(0.0, 20000.0), length: int = 20, seed: int = 43, partitions: int | None = None) -> DataFrame:
    """Generated tuples: relation, ts (ms), seq, payload; of one relation or of both in turn at random.

    seq is 'k-<partition>:<number>'. S strings are five shorter, and only S has a boolean (null for R).
    """
    out = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    tag = F.lit(relation) if relation else F.when(F.rand(seed) < 0.5, "R").otherwise("S")
    integer = (F.floor(F.rand(seed + 1) * (ints[1] - ints[0])) + ints[0]).cast("int")
    real = F.rand(seed + 2) * (doubles[1] - doubles[0]) + doubles[0]
    text = F.when(F.col("relation") == "R", scalars.random_alphanumeric(length, seed + 3)).otherwise(scalars.random_alphanumeric(max(length - 5, 0), seed + 4))
    flag = F.when(F.col("relation") == "S", F.rand(seed + 5) < 0.5)
    payload = F.struct(integer.alias("f1"), real.alias("f2"), text.alias("f3"), flag.alias("f4"))
    seq = F.concat(F.lit("k-"), F.spark_partition_id().cast("string"), F.lit(":"), F.col("id").cast("string"))
    return out.withColumn("relation", tag).select("relation", F.unix_millis(F.current_timestamp()).alias("ts"), seq.alias("seq"), payload.alias("payload"))


def emit_settings(per_second: int) -> tuple[int, int]:
    """(interval in ms, tuples in each) for a rate."""
    interval = 1000 if per_second <= 5 else 500 if per_second <= 20 else 200 if per_second <= 100 else 100
    return interval, per_second * interval // 1000


def rate_stream(spark: SparkSession, per_second: int) -> DataFrame:
    """ts and a running number, `per_second` rows a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("timestamp").alias("ts"), F.col("value").alias("seq"))


def rate_factor(batch: Column, seed: int = 43) -> Column:
    """A factor in [0, 1) that is fixed for a batch: what a fluctuating rate lets through of it."""
    return F.pmod(F.xxhash64(batch, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def fluctuating(rows: DataFrame, seq: str, per_batch: int, seed: int = 43) -> DataFrame:
    """Of each per_batch rows by number, the first ones, as many as the batch's factor says."""
    return rows.where(F.col(seq) % per_batch < rate_factor(F.floor(F.col(seq) / per_batch), seed) * per_batch)


def emitted(rows: DataFrame, ts: str = "ts", seconds: int = 1) -> DataFrame:
    """relation, at, n: how many tuples each relation's source has emitted, by time."""
    return rows.groupBy("relation", F.window(ts, f"{seconds} seconds")["start"].alias("at")).agg(F.count("*").alias("n"))
