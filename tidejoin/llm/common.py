"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

#: Documents that one Python step holds as objects at a time.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir of the session; only a local session, as in tests, may lack it and gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidejoin-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame, rows_per_file: int = 30_000) -> DataFrame:
    """df, computed once and read again from the folder that all executors share, in as few files as its rows fill.

    It is held by the executors while it is counted and written; what they lose meanwhile is computed again.
    """
    shared_folder(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.coalesce(max(1, -(-held.count() // rows_per_file))).checkpoint(eager=True)
    held.unpersist()
    return out


def whole_rows(docs: DataFrame, name: str = "doc") -> Column:
    """All columns as one struct, so that no name of theirs meets one of an operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)


def with_bounded(big: DataFrame, small: DataFrame, on: list[str], rows: int, limit: int = 20_000, how: str = "left") -> DataFrame:
    """big joined with small: by broadcast only if small was counted and has no more than `limit` rows, else by a shuffle that AQE splits where keys are hot."""
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = SLICE) -> DataFrame:
    """f over slices of `rows` rows, so that Python holds few texts at a time, whatever the Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield f(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def remainder(column: str, by: int) -> F.Column:
    """crc32 of a column as text, modulo `by`; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def salted_join(big: DataFrame, small: DataFrame, on: list[str], by: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """big joined with small, whose rows are unique in `on`; a key that many rows of big share is dealt to `salts` tasks by a hash of the column `by`."""
    each = F.explode(F.array(*map(F.lit, range(salts)))).alias("_salt")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return salted.join(small.select("*", each), [*on, "_salt"], how).drop("_salt")


def possible(big: DataFrame, small: DataFrame, on: list[str], most: int = 2**27) -> DataFrame:
    """The rows of big that may have a partner in small: all that have one, and of the others the few whose hash is a partner's.

    small is counted; its hashes are bits of a bitmap, 64 to a row and `most` in all, which is broadcast in pieces of 4096 bytes.
    """
    bits = min(most, 1 << max(15, (64 * small.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    bit = place.bitwiseAND(32767)
    pieces = small.groupBy(F.shiftright(place, 15).alias("_piece")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    own = F.expr("CAST(conv(hex(substring(_bits, CAST(_bit DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    asked = big.withColumn("_piece", F.shiftright(place, 15)).withColumn("_bit", bit).join(F.broadcast(pieces), "_piece")
    return asked.where(F.getbit(own, F.pmod("_bit", F.lit(8)).cast("int")) == 1).select(*big.columns)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its connected component) for every node of edges (u, v), by label propagation and pointer jumping.

    Each round takes the smallest label of the neighbours and then the label of the label, so that chains shorten by more than half.
    Minima are summed up before the shuffle, and labels that many nodes share are salted.
    """
    both = checkpointed(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")))
    while True:
        near = salted_join(both, labels.select(F.col("node").alias("u"), "root"), ["u"], "v").groupBy(F.col("v").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")).persist()
        jumped = salted_join(nearer, nearer.select(F.col("node").alias("root"), F.col("root").alias("next")), ["root"], "node")
        jumped = checkpointed(jumped.select("node", "old", F.least("root", "next").alias("root")))
        nearer.unpersist()
        labels = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return labels
