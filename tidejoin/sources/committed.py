"""A sink of lines that is there whole or not at all: tasks write to a staging folder, and the commit moves what the successful ones have written to its name and puts the end mark last.

Targets may be several (a tee); each has the same lines. A target that is there already is an error, or replaced if overwriting is asked for; it goes only when the new one is complete. A stream's batch is a folder of its own within the target, and a batch that is repeated after
its end mark was put is not written again. An aborted write leaves the target as it was. `committed` reads what has an end mark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidejoin.operators import files

NAME, END = "tidejoin_lines", "EOF"


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    """What a task has written to each target's staging folder."""

    paths: list[str]
    lines: int


class _Lines:
    """The steps that table and stream writes share."""

    def __init__(self, options, overwrite: bool):
        self.targets = [x for x in (options["path"], *options.get("tee", "").split(",")) if x]
        # Tasks and commits have writers of their own; what they share is the options.
        self.overwrite, self.run = overwrite, options.get("run", "1")

    def _staging(self, target: str) -> str:
        return f"{target}.staging-{self.run}"

    def _write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        paths = [f"{self._staging(t)}/part-{uuid.uuid4().hex}.txt" for t in self.targets]
        outs, lines = [], 0
        for path in paths:
            store, at = _at(path)
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            outs.append(store.open_output_stream(at))
        for batch in batches:
            own = [x.encode() + b"\n" for x in batch.column(0).cast(pa.string()).to_pylist() if x is not None]
            lines += len(own)
            for out in outs:
                out.write(b"".join(own))
        for out in outs:
            out.close()
        return Part(paths, lines)

    def _finish(self, messages: list, name: str | None) -> None:
        """Moves the parts of successful tasks to each target (or to its folder `name`), the end mark last."""
        for i, target in enumerate(self.targets):
            whole = target if name is None else f"{target}/{name}"
            store, at = _at(whole)
            there = store.get_file_info(at).type.name != "NotFound"
            marked = store.get_file_info(f"{at}/{END}").is_file
            if name is not None and marked:
                continue  # this batch is there
            if there:
                store.delete_dir(at)
            store.create_dir(at, recursive=True)
            parts = [m for m in messages if m is not None]
            for n, part in enumerate(parts):
                store.move(_at(part.paths[i])[1], f"{at}/part-{n:05d}.txt")
            with store.open_output_stream(f"{at}/{END}") as out:
                out.write(json.dumps({"parts": len(parts), "lines": sum(p.lines for p in parts)}).encode())
        self._clear()

    def _clear(self) -> None:
        for target in self.targets:
            store, at = _at(self._staging(target))
            if store.get_file_info(at).type.name != "NotFound":
                store.delete_dir(at)


class TableWriter(DataSourceArrowWriter, _Lines):
    def __init__(self, options, overwrite: bool):
        _Lines.__init__(self, options, overwrite)
        for target in self.targets:
            store, at = _at(f"{target}/{END}")
            if not overwrite and store.get_file_info(at).is_file:
                raise FileExistsError(f"{target} is there already; ask for overwriting to replace it")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return self._write(iterator)

    def commit(self, messages: list) -> None:
        self._finish(messages, None)

    def abort(self, messages: list) -> None:
        self._clear()


class StreamWriter(DataSourceStreamArrowWriter, _Lines):
    def __init__(self, options, overwrite: bool):
        _Lines.__init__(self, options, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return self._write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self._finish(messages, f"batch={batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self._clear()


class Lines(DataSource):
    """Options: path, tee (further targets, by commas), run (names the staging folder; another one for each run). Writes the first column."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, overwrite)


def write(lines: DataFrame, path: str, *tee: str, overwrite: bool = False) -> None:
    lines.sparkSession.dataSource.register(Lines)
    lines.write.format(NAME).mode("overwrite" if overwrite else "append").option("tee", ",".join(tee)).option("run", uuid.uuid4().hex).save(path)


def write_stream(lines: DataFrame, path: str, checkpoint: str, *tee: str):
    """A stream of lines, to the end of what it has."""
    lines.sparkSession.dataSource.register(Lines)
    writer = lines.writeStream.format(NAME).option("path", path).option("tee", ",".join(tee)).option("run", uuid.uuid4().hex).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """`value`: the lines of a target, or of its batches, that have their end mark."""
    folders = [path] if files.exists(spark, f"{path}/{END}") else [f"{path}/{x}" for x in files.names(spark, path) if x.startswith("batch=") and files.exists(spark, f"{path}/{x}/{END}")]
    empty = spark.createDataFrame([], "value string")
    parts = [f"{folder}/{x}" for folder in folders for x in files.names(spark, folder) if x.startswith("part-")]
    return spark.read.text(parts) if parts else empty


def ended(spark: SparkSession, path: str) -> dict | None:
    """The end mark of a target or of a batch's folder: how many parts and lines it has; None if it isn't complete."""
    if not files.exists(spark, f"{path}/{END}"):
        return None
    return json.loads(spark.read.text(f"{path}/{END}", wholetext=True).first()[0])
