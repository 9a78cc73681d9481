"""The folder that the driver and all executors share, and what is kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a local session, as in tests, may lack that setting and gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidejoin-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    shared_folder(rows.sparkSession, "kept")
    return rows.checkpoint(eager=True)


def ranged(rows: DataFrame, *by: Column) -> DataFrame:
    """The rows with `slice`, the number of their part in the order of `by`: parts of about equal size whatever the values, equal values in one part. Kept, as ranges are found by sampling."""
    return kept(rows.repartitionByRange(*by).withColumn("slice", F.spark_partition_id()))


def narrowed(sums: DataFrame, column: str) -> DataFrame:
    """The rows, kept, with an exact decimal column as bigint if all its values fit, else as it is: no sum is an error for being large."""
    sums = kept(sums)
    low, high = sums.agg(F.min(column), F.max(column)).first()
    fits = low is None or (low >= -(2**63) and high < 2**63)
    return sums.withColumn(column, F.col(column).cast("bigint")) if fits else sums
