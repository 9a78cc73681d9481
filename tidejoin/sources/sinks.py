"""Sinks: text files named by time, settings, result lines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def timed_path(folder: str, prefix: str, suffix: str, at: datetime | None = None) -> str:
    return f"{folder}/{prefix}_{(at or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}.{suffix}"


def write_lines(lines: DataFrame, path: str | None, overwrite: bool = False) -> str | None:
    """A one-column DataFrame as text files; nothing for a null path. An existing path is an error unless overwrite. Spark's _SUCCESS file marks the end."""
    if path is None:
        lines.write.format("noop").mode("overwrite").save()
        return None
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)
    return path


def stream_lines(lines: DataFrame, path: str | None, checkpoint: str, **trigger):
    """A stream of lines to text files (or to the console, without a path), flushed with each micro-batch."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger) if trigger else lines.writeStream.option("checkpointLocation", checkpoint)
    return (writer.format("text").option("path", path) if path else writer.format("console")).start()


def settings_lines(spark: SparkSession, settings: dict) -> DataFrame:
    """A row per setting, in order and in one file: they are few."""
    return spark.createDataFrame([(f"{k} = {v}",) for k, v in sorted(settings.items())], "value string").coalesce(1)


def pair_line(relation: str, r: Column, s: Column) -> Column:
    """'R: <r> ---- <s>' for a pair that a tuple of that relation found."""
    return F.concat(F.lit(f"{relation}: "), r.cast("string"), F.lit(" ---- "), s.cast("string"))


def value_line(seq: Column, value: Column) -> Column:
    return F.concat_ws(" | ", seq.cast("string"), value.cast("string"))


def latency_line(seq: Column, latency: Column) -> Column:
    """'<seq> | <seconds>', for a result's latency."""
    return F.concat_ws(" | ", seq.cast("string"), F.format_string("%.3f", latency))
