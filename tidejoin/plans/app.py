"""A join application: a source by the options, its parsing, placement, the join, and a sink.

    python -m tidejoin --source random -win -wr 2 -ws 2 --s grouped --out results
    python -m tidejoin --source files --r-path trips --s-path tracks --s routed -t 2.2 --out results
    python -m tidejoin --source kafka --brokers host:9092 --size 30G --s routed --out results

Generated tuples join on the fields that -jr and -js name. Records of files and topics are streams that join on the geohash of their coordinates: by Spark's own stream join for equality under hash placement, else
by micro-batches, in which `routed` moves keys when the imbalance passes -t after the warm-up of -st milliseconds, in checks of -i milliseconds.
Without --out results are computed and thrown away.
"""

from __future__ import annotations

import argparse
import math
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidejoin.operators import joins
from tidejoin.plans import options
from tidejoin.sources import records, sinks
from tidejoin.streaming import joins as streams
from tidejoin.streaming.engine import Engine

FIELDS = 4


def _source(spark: SparkSession, o: argparse.Namespace, per_second: int, relation: str | None, seed: int, start_ms: int) -> DataFrame:
    rows = records.random_tuples(spark, per_second * o.lrt, relation, (o.il, o.iu), (o.dl, o.du), o.c, seed)
    number = F.element_at(F.split("seq", ":"), -1).cast("long")
    rows = rows.withColumn("number", number).withColumn("ts", F.timestamp_millis(F.lit(start_ms) + F.floor(number * 1000 / max(per_second, 1))))
    return records.fluctuating(rows, "number", max(records.emit_settings(per_second)[1], 1), seed) if o.fluc else rows


def generated(spark: SparkSession, o: argparse.Namespace, start_ms: int | None = None) -> DataFrame:
    """relation, ts, number, seq, payload of -lrt seconds: -tr and -ts tuples a second from a source for each relation, or, where both are 0, -trs from one source of both.

    Their times are spread over the seconds; with -fluc a part of each batch is left out.
    """
    start = int(time.time() * 1000) if start_ms is None else start_ms
    if not o.tr and not o.ts:
        return _source(spark, o, o.trs, None, 43, start)
    r, s = _source(spark, o, o.tr, "R", 43, start), _source(spark, o, o.ts, "S", 53, start)
    return r.unionByName(s)


def relations(o: argparse.Namespace, tuples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R and S of generated tuples, keyed by the join fields; where their types differ, both are compared as text."""
    if max(o.join_field_r, o.join_field_s) >= FIELDS:
        raise ValueError(f"generated tuples have {FIELDS} fields")
    names = [f"f{i + 1}" for i in (o.join_field_r, o.join_field_s)]
    types = {tuples.schema["payload"].dataType[name].dataType.simpleString() for name in names}
    key = lambda name: F.col(f"payload.{name}").cast("string") if len(types) > 1 else F.col(f"payload.{name}")
    return tuple(tuples.where(F.col("relation") == x).select(key(name).alias("key"), "seq", "ts") for x, name in zip("RS", names))


def text_streams(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """topic and value of new lines in folders, {topic: folder}: message streams without brokers."""
    parts = [spark.readStream.text(folder).select(F.lit(topic).alias("topic"), "value") for topic, folder in folders.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _native(o: argparse.Namespace, tuples: DataFrame) -> DataFrame:
    """Equality under hash placement is Spark's own stream join, by whose state no key moves."""
    r, s = (tuples.where(F.col("relation") == x).select("key", "ts", "value") for x in "RS")
    pairs = streams.windowed(r, s, *o.window, "10 seconds") if o.window else streams.full_history(r, s)
    with streams.rocksdb(tuples.sparkSession):
        out = streams.run_available(pairs.select(F.col("key").alias("key_r"), F.col("key").alias("key_s"), "value_r", "value_s", "ts_r", "ts_s"))
    return out if o.no_dedup else out.dropDuplicates(["value_r", "value_s"])


def join_records(spark: SparkSession, o: argparse.Namespace, tagged: DataFrame) -> DataFrame:
    """The pairs of tagged records (relation, value), a stream or a table: key_r, key_s, value_r, value_s, ts_r, ts_s. Two pairs with the same two records are repeats."""
    tuples = records.geo_tuples(tagged)
    if tuples.isStreaming:
        if o.op == "=" and o.strategy == "hash":
            return _native(o, tuples)
        moving = o.strategy == "routed"
        where = joins.placement_of(o.strategy, o.pr, o.rm, "value") if o.strategy in ("random", "grouped") else None
        out = Engine(spark, o.op, o.window, o.pr, o.t, math.ceil(o.st / o.i), rebalance=moving, placement=where).run(tuples)
    else:
        r, s = (tuples.where(F.col("relation") == x).select("key", "ts", "value", F.col("value").alias("seq")) for x in "RS")
        out = joins.join(r, s, o.op, o.window, o.strategy, **options.placement_options(o))
        out = out.withColumn("key_r", F.col("key")).withColumn("key_s", F.col("key")) if "key" in out.columns else out
    out = out.select("key_r", "key_s", "value_r", "value_s", "ts_r", "ts_s")
    return out if o.no_dedup else out.dropDuplicates(["value_r", "value_s"])


def result_lines(o: argparse.Namespace, pairs: DataFrame, r: Column, s: Column) -> DataFrame:
    """`line`: key and later record of each pair, or both sides with the relation that came later."""
    later = F.when(F.col("ts_r") > F.col("ts_s"), sinks.pair_line("R", r, s)).otherwise(sinks.pair_line("S", s, r))
    return pairs.select((sinks.value_line(r, s) if o.simple_output else later).alias("line"))


def write(spark: SparkSession, o: argparse.Namespace, lines: DataFrame) -> str | None:
    if o.d:
        sinks.write_lines(options_lines(spark, o), sinks.timed_path(o.d, o.name, "settings"))
    return sinks.write_lines(lines, None if o.no_output or not o.out else sinks.timed_path(o.out, f"{o.name}-{o.strategy}", "txt"))


def options_lines(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return sinks.settings_lines(spark, options.settings(o))


def run(spark: SparkSession, o: argparse.Namespace) -> str | None:
    """Source, join and sink by the options; the path of the results."""
    if o.source == "random":
        r, s = relations(o, generated(spark, o))
        plain = argparse.Namespace(**{**vars(o), "simple_output": False, "no_output": False})
        pairs = options.plan(plain, r, s)
        if o.agg:
            return write(spark, o, pairs.select(F.to_json(F.struct("*")).alias("line")))
        return write(spark, o, result_lines(o, pairs, F.col("seq_r"), F.col("seq_s")))
    topics = records.topics_for(o.size)
    if o.source == "kafka":
        tagged = records.kafka(spark, o.brokers, topics, o.z)
    else:
        tagged = records.tagged(text_streams(spark, dict(zip(topics, (o.r_path, o.s_path)))), topics)
    return write(spark, o, result_lines(o, join_records(spark, o, tagged), F.col("value_r"), F.col("value_s")))


def parse(args: list[str]) -> argparse.Namespace:
    p = options.parser()
    p.add_argument("--source", choices=("random", "files", "kafka"), default="random")
    p.add_argument("--r-path", dest="r_path", help="folder of R's records")
    p.add_argument("--s-path", dest="s_path", help="folder of S's records")
    p.add_argument("--brokers", default="localhost:9092")
    p.add_argument("--out", help="folder for the results")
    o = options.parse(args, p)
    if o.source == "files" and not (o.r_path and o.s_path):
        p.error("--source files needs --r-path and --s-path")
    return o


def main(args: list[str] | None = None) -> None:
    import sys

    o = parse(sys.argv[1:] if args is None else args)
    builder = SparkSession.builder.appName(f"{o.name}-{o.strategy}")
    spark = (builder.master("local[*]") if o.local else builder).getOrCreate()
    path = run(spark, o)
    print(path or "no output")
    spark.stop()
