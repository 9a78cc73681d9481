"""An ordered index that is kept: a multimap from keys to values in a folder, changed by small writes and asked by reading only what a question hits.

The index is slices of the key order, each a sorted file of (key, value, n), and zones, a row for each slice with its least key and its number of keys. A change is a small table of its own: rows that are put, keys that are
removed, or single values that are. A question finds the slices of its probes in the zones, reads these and the changes, and settles what is live: of a key, what came after its last removal; of a value, puts less removals in
their order. `compact` settles the slices that changes have touched, writes these anew (split where they have grown) and leaves all others as they are; questions and changes go on with the new zones.

An index is opened by its folder, so it outlives its process. A change or a compaction is seen once it is written whole; one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidejoin.operators import files
from tidejoin.operators.shared import kept, ranged

#: Rows (different values of a key) of a slice, about; one that a compaction finds with twice as many is split.
SLICE_ROWS = 100_000
PUT, REMOVE_KEY, REMOVE_VALUE = 0, 1, 2


class KeptIndex:
    """folder: where it lies. key, value: types of both; needed for a new index only."""

    def __init__(self, spark: SparkSession, folder: str, key: T.DataType | str = "long", value: T.DataType | str = "long", slice_rows: int = SLICE_ROWS):
        self.spark, self.folder, self.slice_rows = spark, folder, slice_rows
        self.rows = spark.createDataFrame([], f"k {key if isinstance(key, str) else key.simpleString()}, v {value if isinstance(value, str) else value.simpleString()}").schema
        self.key, self.value = self.rows["k"].dataType, self.rows["v"].dataType
        #: Files of slices that the last question read.
        self.read_last: list[str] = []

    # --- what is written

    def _version(self) -> int:
        return max(files.batches(self.spark, f"{self.folder}/zones"), default=-1)

    def _zones(self, version: int) -> DataFrame:
        """slice (its number in the order of the keys), path, low (least key that belongs to it; the first slice's is null and stands for all below), keys."""
        fields = {"slice": T.IntegerType(), "path": T.StringType(), "low": self.key, "keys": T.LongType()}
        schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
        return self.spark.createDataFrame([], schema) if version < 0 else self.spark.read.schema(schema).parquet(f"{self.folder}/zones/batch={version}")

    def _changes(self, version: int) -> list[int]:
        """Changes that the version's slices don't have."""
        return [b for b in files.batches(self.spark, f"{self.folder}/changes") if b >= self._first_change(version)]

    def _first_change(self, version: int) -> int:
        # A version's number is that of the first change after it.
        return max(version, 0)

    def _next(self) -> int:
        return max([self._first_change(self._version()) - 1, *files.batches(self.spark, f"{self.folder}/changes")]) + 1

    def _change(self, rows: DataFrame, kind: int) -> None:
        value = F.col("value").cast(self.value) if kind != REMOVE_KEY else F.lit(None).cast(self.value)
        rows = rows.where("key IS NOT NULL").select(F.col("key").cast(self.key).alias("key"), value.alias("value"))
        rows = rows.groupBy("key", "value").agg(F.count("*").alias("n"))
        rows.select("key", "value", "n", F.lit(kind).alias("kind")).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={self._next()}")

    def put(self, rows: DataFrame) -> None:
        """Adds rows of key and value; rows without a key are left out."""
        self._change(rows, PUT)

    def remove(self, keys: DataFrame) -> None:
        """Removes keys with all their values; absent ones change nothing."""
        self._change(keys, REMOVE_KEY)

    def remove_values(self, pairs: DataFrame) -> None:
        """Removes one equal value for each row of pairs, as far as there are any."""
        self._change(pairs, REMOVE_VALUE)

    # --- what is live

    def _in_slices(self, rows: DataFrame, at: str, zones: DataFrame) -> DataFrame:
        """rows with `slice`, the one that the key `at` belongs to: by a window over keys and bounds, as there may be any number of either."""
        both = rows.select(F.struct(*rows.columns).alias("row"), F.col(at).alias("k"), F.lit(None).cast("int").alias("own"), F.lit(1).alias("kind"))
        bounds = zones.where("low IS NOT NULL").select(F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col("low").alias("k"), F.col("slice").alias("own"), F.lit(0).alias("kind"))
        parts = ranged(both.unionAll(bounds), F.col("k"))
        order = Window.partitionBy("part").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumnRenamed("slice", "part")
        # Slices are numbered in their order, so a part without bounds of its own has the last one of the parts before.
        last = parts.groupBy("part").agg(F.max("own").alias("most"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        last = last.select("part", F.max("most").over(before).alias("before"))
        here = parts.withColumn("own", F.max("own").over(order)).where("kind = 1").join(last, "part")
        return here.select("row.*", F.coalesce("own", "before", F.lit(0)).alias("slice"))

    def _all_changes(self, version: int) -> DataFrame:
        """key, value, n, kind, batch of all changes since the version."""
        numbers = self._changes(version)
        schema = T.StructType([T.StructField("key", self.key), T.StructField("value", self.value), T.StructField("n", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("batch", T.IntegerType())])
        if not numbers:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/changes/batch={b}" for b in numbers]
        return self.spark.read.option("basePath", f"{self.folder}/changes").schema(schema).parquet(*paths)

    def _live(self, slices: list[int], zones: DataFrame, changes: DataFrame) -> DataFrame:
        """slice, key, value, n of what is live in these slices. changes: with `slice`."""
        paths = [r["path"] for r in zones.where(F.col("slice").isin(slices)).select("path").collect()] if slices else []
        self.read_last = sorted({*self.read_last, *paths})
        events = changes.where(F.col("slice").isin(slices)).select("slice", "key", "value", "n", "kind", "batch")
        if paths:
            stored = self.spark.read.option("basePath", f"{self.folder}/slices").schema(T.StructType([T.StructField("key", self.key), T.StructField("value", self.value), T.StructField("n", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("version", T.IntegerType())])).parquet(*paths)
            # A file's slice is numbered by its version; the zones number it as of now.
            number = lambda name: F.regexp_extract("path", rf"{name}=(\d+)", 1).cast("int")
            now = zones.where(F.col("slice").isin(slices)).select(number("version").alias("version"), number("slice").alias("old"), F.col("slice").alias("now"))
            stored = stored.withColumnRenamed("slice", "old").join(now, ["version", "old"]).select(F.col("now").alias("slice"), "key", "value", "n", F.lit(PUT).alias("kind"), F.lit(-1).alias("batch"))
            events = events.unionAll(stored)
        removed = events.where(F.col("kind") == REMOVE_KEY).groupBy("key").agg(F.max("batch").alias("removed"))
        events = events.where(F.col("kind") != REMOVE_KEY).join(removed, "key", "left").where(F.col("removed").isNull() | (F.col("batch") > F.col("removed")))
        signed = F.when(F.col("kind") == PUT, F.col("n")).otherwise(-F.col("n"))
        steps = events.groupBy("slice", "key", "value").agg(F.array_sort(F.collect_list(F.struct("batch", signed.alias("n")))).alias("steps"))
        left = F.aggregate("steps", F.lit(0).cast("long"), lambda acc, x: F.greatest(F.lit(0).cast("long"), acc + x["n"]))
        return steps.select("slice", "key", "value", left.alias("n")).where("n > 0")

    def _open(self) -> tuple[DataFrame, DataFrame]:
        """Zones and changes (with `slice`) as of now."""
        self.read_last = []
        version = self._version()
        zones = self._zones(version)
        return zones, kept(self._in_slices(self._all_changes(version), "key", zones))

    @staticmethod
    def _slices(rows: DataFrame) -> list[int]:
        """Numbers of the slices that rows lie in; at most as many as the index has."""
        return [r[0] for r in rows.select("slice").distinct().collect()]

    # --- questions

    def get(self, probes: DataFrame) -> DataFrame:
        """key, values (ascending, repeats too): of the probes' keys; null for absent ones."""
        zones, changes = self._open()
        asked = kept(self._in_slices(probes.select(F.col("key").cast(self.key).alias("key")), "key", zones))
        live = self._live(self._slices(asked), zones, changes).join(asked.select("key").distinct(), "key", "left_semi")
        values = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda x: F.array_repeat(x["value"], x["n"].cast("int"))))
        return asked.select("key").join(live.groupBy("key").agg(values.alias("values")), "key", "left")

    def floor(self, probes: DataFrame) -> DataFrame:
        """key (of the probe), found: the largest live key that isn't above it; null if there is none.

        It lies in the probe's slice, unless that has no live key up to the probe; only such probes look into the slice before, and so on.
        """
        zones, changes = self._open()
        left = kept(self._in_slices(probes.select(F.col("key").cast(self.key).alias("key")).distinct(), "key", zones))
        done = []
        while True:
            slices = self._slices(left)
            if not slices:
                break
            keys = self._live(slices, zones, changes).select("slice", F.col("key").alias("at"), F.col("key").alias("found"), F.lit(0).alias("kind")).distinct()
            asked = left.select("slice", F.col("key").alias("at"), F.lit(None).cast(self.key).alias("found"), F.lit(1).alias("kind"), "key")
            both = keys.withColumn("key", F.lit(None).cast(self.key)).unionByName(asked)
            last = F.last("found", ignorenulls=True).over(Window.partitionBy("slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
            looked = kept(both.withColumn("found", last).where("kind = 1").select("key", "slice", "found"))
            done.append(looked.where("found IS NOT NULL OR slice = 0").select("key", "found"))
            # What isn't found is below the slice's keys: any key of the slice before will do.
            left = looked.where("found IS NULL AND slice > 0").select("key", (F.col("slice") - 1).alias("slice"))
        out = self.spark.createDataFrame([], T.StructType([T.StructField("key", self.key), T.StructField("found", self.key)]))
        for part in done:
            out = out.unionByName(part)
        return out

    def rank(self, probes: DataFrame) -> DataFrame:
        """key (of the probe), rank: how many live keys are below it. Slices that no probe and no change lies in are counted by their zones."""
        zones, changes = self._open()
        asked = kept(self._in_slices(probes.select(F.col("key").cast(self.key).alias("key")).distinct(), "key", zones))
        touched = self._slices(changes)
        live = kept(self._live(sorted({*self._slices(asked), *touched}), zones, changes).select("slice", "key").distinct())
        counts = zones.where(~F.col("slice").isin(touched)).select("slice", "keys") if touched else zones.select("slice", "keys")
        counts = counts.unionByName(live.where(F.col("slice").isin(touched)).groupBy("slice").agg(F.count("*").alias("keys")))
        # A row for each slice.
        below = counts.join(asked.select("slice").distinct(), "slice", "full").select("slice", F.coalesce("keys", F.lit(0)).alias("keys"))
        below = below.withColumn("below", F.coalesce(F.sum("keys").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("keys")
        both = live.select("slice", "key", F.lit(1).alias("own")).unionAll(asked.select("slice", "key", F.lit(0)))
        before = F.sum("own").over(Window.partitionBy("slice").orderBy("key", "own").rowsBetween(Window.unboundedPreceding, -1))
        within = both.withColumn("within", F.coalesce(before, F.lit(0))).where("own = 0").join(below, "slice")
        return within.select("key", (F.col("below") + F.col("within")).cast("bigint").alias("rank"))

    def size(self) -> int:
        """How many live keys there are."""
        zones, changes = self._open()
        touched = self._slices(changes)
        rest = zones.where(~F.col("slice").isin(touched)).agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]
        return rest + self._live(touched, zones, changes).select("key").distinct().count()

    # --- compaction

    def compact(self) -> list[int]:
        """Writes the slices that changes have touched anew, and the zones of all; the numbers (of now) of those that were."""
        version, number = self._version(), self._next()
        if not self._changes(version):
            return []
        zones, changes = self._open()
        touched = self._slices(changes)
        live = kept(self._live(touched, zones, changes))
        sizes = live.groupBy("slice").agg(F.count("*").alias("rows"))
        # Slices that have grown are cut in the order of their keys, by rows; a key stays whole.
        grown = sizes.where(F.col("rows") > 2 * self.slice_rows).select("slice")
        keys = live.join(grown, "slice", "left_semi").groupBy(F.col("slice").alias("old"), "key").agg(F.count("*").alias("rows"))
        keys = ranged(keys, F.col("old"), F.col("key")).withColumnRenamed("slice", "part")
        ahead = F.coalesce(F.sum("rows").over(Window.partitionBy("old", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        keys = keys.select(F.col("old").alias("slice"), "key", "part", F.floor(ahead / self.slice_rows).cast("int").alias("piece"))
        whole = live.join(grown, "slice", "left_anti").select(F.col("slice").alias("old"), F.lit(0).alias("part"), F.lit(0).alias("piece"), "key", "value", "n")
        parts = kept(whole.unionAll(live.join(keys, ["slice", "key"]).select("slice", "part", "piece", "key", "value", "n")))
        made = parts.groupBy("old", "part", "piece").agg(F.min("key").alias("low"), F.countDistinct("key").alias("keys"))
        # New numbers in the order of the keys, over rows that are one for each slice.
        named = kept(made.withColumn("file", F.row_number().over(Window.orderBy("old", "part", "piece"))))
        folder = f"{self.folder}/slices/version={number}"
        own = named.select("old", "part", "piece", F.col("file").alias("slice"))
        out = parts.join(own, ["old", "part", "piece"]).select("key", "value", "n", "slice")
        out.repartitionByRange("slice", "key", "value").sortWithinPartitions("slice", "key", "value").write.mode("overwrite").partitionBy("slice").parquet(folder)
        path = F.concat(F.lit(f"{folder}/slice="), F.col("file").cast("string"))
        old_low = zones.select(F.col("slice").alias("old"), F.col("low").alias("old_low"))
        fresh = named.join(old_low, "old", "left")
        # The first of a slice's parts keeps its bound, so that keys between slices stay where they belong.
        first = F.row_number().over(Window.partitionBy("old").orderBy("part", "piece")) == 1
        fresh = fresh.select("old", "part", "piece", path.alias("path"), F.when(first, F.col("old_low")).otherwise(F.col("low")).alias("low"), "keys")
        same = zones.where(~F.col("slice").isin(touched)).select(F.col("slice").alias("old"), F.lit(0).alias("part"), F.lit(0).alias("piece"), "path", "low", "keys")
        both = same.unionByName(fresh)
        place = (F.row_number().over(Window.orderBy("old", "part", "piece")) - 1).cast("int")
        zone = both.withColumn("slice", place)
        # Whatever is below the first slice's keys belongs to it.
        zone = zone.select("slice", "path", F.when(F.col("slice") > 0, F.col("low")).alias("low"), F.col("keys").cast("long").alias("keys"))
        zone.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/zones/batch={number}")
        return touched

    def sweep(self) -> None:
        """Deletes what no question can hit any more: changes and zones before the present version, and files of slices that it doesn't have."""
        version = self._version()
        for name in ("changes", "zones"):
            for b in files.batches(self.spark, f"{self.folder}/{name}"):
                if b < version:
                    files.delete(self.spark, f"{self.folder}/{name}/batch={b}")
        used = {r.path.rsplit("/", 2)[1] + "/" + r.path.rsplit("/", 1)[1] for r in self._zones(version).select("path").collect()}
        for v in files.names(self.spark, f"{self.folder}/slices"):
            for s in files.names(self.spark, f"{self.folder}/slices/{v}"):
                if s.startswith("slice=") and f"{v}/{s}" not in used:
                    files.delete(self.spark, f"{self.folder}/slices/{v}/{s}")


def build(spark: SparkSession, folder: str, rows: DataFrame, slice_rows: int = SLICE_ROWS) -> KeptIndex:
    """A new index of rows (key, value)."""
    out = KeptIndex(spark, folder, rows.schema["key"].dataType, rows.schema["value"].dataType, slice_rows)
    out.put(rows)
    out.compact()
    return out


