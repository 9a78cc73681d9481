"""A table replayed as a stream at a given rate, which may fluctuate: a data source whose offset is a tick of its clock, so what a batch has is fixed by the seed, not by when it runs.

`prepare` writes the rows in their order, numbered, in files of a few thousand rows, with an index of the files. Tick t releases the next `tuples` rows, or with fluctuation a part of them that a hash of the seed and t gives. A batch is a tick;
it reads the files that its numbers lie in, each in a task of its own. The last planned tick is noted beside the files, so a reader that starts anew goes on after it, and Spark's own log replays a batch that was lost: each row comes once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidejoin.operators.shared import ranged
from tidejoin.sources.records import emit_settings

NAME = "tidejoin_replay"


def prepare(rows: DataFrame, folder: str, *order: Column, rows_per_file: int = 5000) -> str:
    """Writes rows, numbered from 0 in their order, and the index of their files; the folder."""
    spark = rows.sparkSession
    parts = ranged(rows, *order)
    sizes = parts.groupBy("slice").agg(F.count("*").alias("here"))
    ahead = F.coalesce(F.sum("here").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    within = F.row_number().over(Window.partitionBy("slice").orderBy(*order)) - 1
    numbered = parts.withColumn("_within", within).join(sizes.select("slice", ahead.alias("_ahead")), "slice")
    numbered = numbered.withColumn("_number", (F.col("_ahead") + F.col("_within")).cast("long")).drop("_ahead", "_within", "slice")
    # Row groups of few rows, so that a batch reads what it needs of a file.
    numbered.sortWithinPartitions("_number").write.option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/rows")
    found = spark.read.parquet(f"{folder}/rows").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("_number").alias("first"), F.max("_number").alias("last"))
    found.coalesce(1).write.json(f"{folder}/index")
    return folder


def factor(seed: int, tick: int) -> float:
    """In [0, 1): what tick lets through of its rows if the rate fluctuates."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{tick}".encode(), digest_size=6).digest()) / 2**48


def released(tick: int, tuples: int, seed: int | None) -> int:
    """Rows of a tick; one at least, so that a replay ends."""
    return tuples if seed is None else max(1, int(tuples * factor(seed, tick)))


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Rows(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class Reader(DataSourceStreamReader):
    def __init__(self, options, schema: StructType):
        self.folder, self.schema = options["path"], schema
        self.tuples = emit_settings(int(options.get("per_second", 1000)))[1]
        self.seed = int(options["seed"]) if options.get("fluctuating", "false").lower() == "true" else None
        store, at = _store(f"{self.folder}/index")
        from pyarrow import fs

        self.files = []
        for info in store.get_file_info(fs.FileSelector(at)):
            if info.base_name.startswith("part-"):
                self.files += [json.loads(line) for line in store.open_input_stream(info.path).read().decode().splitlines()]
        self.files.sort(key=lambda x: x["first"])
        self.total = self.files[-1]["last"] + 1 if self.files else 0

    def _noted(self) -> dict | None:
        store, at = _store(f"{self.folder}/_planned.json")
        return json.loads(store.open_input_stream(at).read()) if store.get_file_info(at).is_file else None

    def initialOffset(self) -> dict:
        return {"tick": 0, "row": 0}

    def latestOffset(self) -> dict:
        """One tick after the last planned one; the same again at the end of the table."""
        now = self._noted() or self.initialOffset()
        if now["row"] >= self.total:
            return now
        return {"tick": now["tick"] + 1, "row": min(self.total, now["row"] + released(now["tick"], self.tuples, self.seed))}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        noted = self._noted()
        if noted is None or end["tick"] > noted["tick"]:
            store, at = _store(f"{self.folder}/_planned.json")
            with store.open_output_stream(at) as out:
                out.write(json.dumps(end).encode())
        own = [x for x in self.files if x["first"] < end["row"] and x["last"] >= start["row"]]
        return [Rows(x["path"], max(start["row"], x["first"]), min(end["row"], x["last"] + 1)) for x in own]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        store, at = _store(partition.path)
        number = ds.field("_number")
        rows = ds.dataset(at, format="parquet", filesystem=store).scanner(columns=self.schema.names, filter=(number >= partition.first) & (number < partition.end))
        types = to_arrow_schema(self.schema)
        for batch in rows.to_batches():
            # Spark's files may have other units of time than its batches.
            yield pa.record_batch([column.cast(kind, safe=False) for column, kind in zip(batch.columns, types.types)], schema=types)

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    """Options: path (of `prepare`), per_second, fluctuating, seed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)


def replay(spark: SparkSession, folder: str, per_second: int, fluctuating: bool = False, seed: int = 43) -> DataFrame:
    """The stream of a prepared folder: a batch has the rows of one tick."""
    spark.dataSource.register(Replay)
    schema = StructType([f for f in spark.read.parquet(f"{folder}/rows").schema.fields if f.name != "_number"])
    return spark.readStream.format(NAME).schema(schema).option("per_second", per_second).option("fluctuating", str(fluctuating)).option("seed", seed).load(folder)


def run_all(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Every tick that is left, a batch each, into Parquet folders by batch."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
