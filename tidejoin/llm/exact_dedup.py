"""Exact deduplication over an index of cuckoo filters.

Each document becomes a content key (SHA-256 of its text without white space). Keys are dealt to buckets by their
first bits; a bucket holds a cuckoo filter of the live keys' fingerprints and, as the content to verify against, the
keys themselves, each with its copies and the document that stays. A key that the filter doesn't know is new, without a look at the stored keys. A hit is verified
against the bucket's keys, so a false positive never merges different texts. Where a filter overflows, it is built
anew, twice as large, from the stored keys; where buckets fill up, the index is dealt to more of them, from the stored keys too. Copies are summed up per key and salt before the shuffle, so that a key that a third
of all documents share reaches its bucket as `salts` rows. An insertion or deletion writes the buckets that it touches, and every eighth one all of them.

The documents of each key are a log beside the index, never in a bucket: rows come with their number, and go with a negative one. Only a deletion reads it, for its own keys, to find the next
best document of each.

Defined results: a null text is the empty text; empty texts equal one another; of equal texts, the one with most code
points stays, then the smallest doc_id (null last), rows alike in both are one and the same choice; a very long text is one digest, of all of it; an empty table gives
an empty result; deleting what the index doesn't have changes nothing. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_slices, salted_join, table, utf8

SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SLOTS = 4
KICKS = 200
KEYS_PER_BUCKET = 1000
#: Changes between two that write all buckets.
CHANGES = 8
#: best: code points, whether doc_id is null, doc_id (0 where it is), of the document that stays; a filter's row has zeros there.
BEST = "points long, none boolean, doc_id long"
STATE = f"bucket int, digest binary, size long, {BEST}, filter binary"
MEMBERS = f"digest binary, {BEST}, size long"
COLUMNS = [x.split()[0] for x in STATE.split(", ")]


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four slots, each fingerprint in one of two buckets."""

    def __init__(self, buckets: int = 64):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def __bytes__(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[10:18], "little") % len(self.table)
        return mark, first, self._other(first, mark)

    def _other(self, at: int, mark: int) -> int:
        return at ^ (mark * 0x5BD1E995) % len(self.table)

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, key: bytes) -> bool:
        """False on overflow; the filter then lacks some key and must be built anew, see `grown`."""
        mark, a, b = self._places(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = b
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            found = np.flatnonzero(self.table[at] == mark)
            if len(found):
                self.table[at, found[0]] = 0
                return True
        return False

    @classmethod
    def grown(cls, keys: list[bytes], buckets: int) -> CuckooFilter:
        """A filter of all keys with at least `buckets` buckets (a power of two)."""
        while True:
            out = cls(buckets)
            if all(out.insert(k) for k in keys):
                return out
            buckets *= 2


def content_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the text without white space, code points of the text as it is."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        digests = [hashlib.sha256(x.translate(None, SPACE)).digest() for x in texts]
        points = [len(x.translate(None, CONTINUATION)) for x in texts]
        return pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(points, pa.int32())], ["doc_id", "digest", "points"])

    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), keys, "doc_id long, digest binary, points int")


def _bucket(buckets: int) -> F.Column:
    return (F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % buckets).cast("int")


def _step(state: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """A bucket's state after the batch: rows with size > 0 insert a document, those with size < 0 delete and name the one that stays then."""
    bucket = int((state if len(state) else batch)["bucket"].iloc[0])
    held, filters = state[state["filter"].isna()], state["filter"].dropna()
    keys = {bytes(d): (int(n), (-int(p), bool(x), int(i))) for d, n, p, x, i in held[["digest", "size", "points", "none", "doc_id"]].itertuples(index=False)}
    # A bucket that was split has keys and no filter yet.
    known = CuckooFilter.read(filters.iloc[0]) if len(filters) else CuckooFilter.grown(list(keys), 64)
    for digest, size, points, none, doc_id in batch[["digest", "size", "points", "none", "doc_id"]].itertuples(index=False):
        digest, size, best = bytes(digest), int(size), (-int(points), bool(none), int(doc_id))
        # The filter first: what it doesn't know needs no look at the keys, what it knows is held against them.
        if digest in known and digest in keys:
            copies, before = keys[digest]
            if copies + size > 0:
                keys[digest] = copies + size, min(before, best) if size > 0 else best
            else:
                del keys[digest]
                known.delete(digest)
        elif size > 0:
            keys[digest] = size, best
            if not known.insert(digest):
                known = CuckooFilter.grown(list(keys), 2 * len(known.table))
    rows = [(bucket, k, n, -p, x, i, None) for k, (n, (p, x, i)) in keys.items()] + [(bucket, None, 0, 0, False, 0, bytes(known))]
    return pd.DataFrame(rows, columns=COLUMNS)


def _best() -> F.Column:
    """Of a group's rows, the document that stays."""
    return F.min(F.struct((-F.col("points")).alias("p"), F.col("none"), F.col("doc_id"))).alias("best")


def _documents(keys: DataFrame) -> DataFrame:
    return keys.select("digest", F.col("points").cast("long").alias("points"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"))


class CuckooIndex:
    """Live content keys in buckets; `state` has a row for each key (its copies, and the document that stays) and one for each bucket's filter. `members` is the log of the documents
    of each key. Buckets are split when they come to hold twice `keys_per_bucket` keys on average. `changes` counts those since all buckets were written."""

    def __init__(self, spark: SparkSession, buckets: int = 1, keys_per_bucket: int = KEYS_PER_BUCKET, state: DataFrame | None = None, members: DataFrame | None = None, changes: int = 0):
        self.spark, self.buckets, self.keys_per_bucket, self.changes = spark, buckets, keys_per_bucket, changes
        self.state, self.members = state, members if members is not None else spark.createDataFrame([], MEMBERS)

    def _apply(self, batch: DataFrame, members: DataFrame) -> CuckooIndex:
        """batch: digest, size, best; a hot key's few rows are its sums by salt. members: what comes to the log."""
        batch = batch.select(_bucket(self.buckets).alias("bucket"), "digest", "size", (-F.col("best.p")).alias("points"), "best.none", "best.doc_id")
        if self.state is None:
            empty = pd.DataFrame(columns=COLUMNS)
            out = checkpointed(batch.groupBy("bucket").applyInPandas(lambda rows: _step(empty, rows), STATE))
            return CuckooIndex(self.spark, self.buckets, self.keys_per_bucket, out, checkpointed(members, 200_000))
        batch = checkpointed(batch)
        touched = batch.select("bucket").distinct()
        of_touched = self.state.join(touched, "bucket", "left_semi")
        out = checkpointed(of_touched.groupBy("bucket").cogroup(batch.groupBy("bucket")).applyInPandas(_step, STATE))
        out = self.state.join(touched, "bucket", "left_anti").unionByName(out)
        log = self.members.unionByName(checkpointed(members, 200_000))
        changes = (self.changes + 1) % CHANGES
        if not changes:
            by = ["digest", "points", "none", "doc_id"]
            out, log = checkpointed(out), checkpointed(log.groupBy(*by).agg(F.sum("size").alias("size")).where("size > 0"), 200_000)
        return CuckooIndex(self.spark, self.buckets, self.keys_per_bucket, out, log, changes)

    def _split(self) -> CuckooIndex:
        """The index in as many buckets as its keys call for; filters of new buckets are made from the stored keys at the next step."""
        live = self.state.where("digest IS NOT NULL").count()
        if live <= 2 * self.keys_per_bucket * self.buckets:
            return self
        buckets = -(-live // self.keys_per_bucket)
        keys = self.state.where("digest IS NOT NULL").withColumn("bucket", _bucket(buckets))
        return CuckooIndex(self.spark, buckets, self.keys_per_bucket, keys, self.members, self.changes)

    def insert(self, keys: DataFrame, salts: int = 8) -> CuckooIndex:
        """The index with the documents of `keys` (from `content_keys`) in it."""
        documents = _documents(keys)
        members = documents.groupBy("digest", "points", "none", "doc_id").agg(F.count("*").alias("size"))
        salted = documents.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(F.count("*").alias("size"), _best())
        return self._apply(salted, members)._split()

    def delete(self, keys: DataFrame) -> CuckooIndex:
        """The index without one copy for each row of `keys` that it has; a key whose last copy goes leaves the filter too, and where the document that stayed goes, the next best stays."""
        if self.state is None:
            return self
        by = ["digest", "points", "none", "doc_id"]
        asked = checkpointed(_documents(keys).groupBy(*by).agg(F.count("*").alias("less")))
        had = self.members.join(asked.select("digest").distinct(), "digest", "left_semi").groupBy(*by).agg(F.sum("size").alias("size")).where("size > 0")
        left = checkpointed(had.join(asked, by, "left").withColumn("less", F.least("size", F.coalesce("less", F.lit(0)))), 200_000)
        gone = left.where("less > 0").groupBy("digest").agg((-F.sum("less")).alias("size"))
        # A key of which nothing is left names any document: it goes.
        rest = left.withColumn("rest", F.col("size") > F.col("less")).groupBy("digest", "rest").agg(_best())
        rest = rest.groupBy("digest").agg(F.max_by("best", "rest").alias("best"))
        return self._apply(gone.join(rest, "digest"), left.where("less > 0").select(*by, (-F.col("less")).alias("size")))

    def live(self) -> DataFrame:
        """digest, points, keep_id (the document that stays), group_size of each key, as the buckets have them."""
        return self.state.where("digest IS NOT NULL").select("digest", "points", F.when(~F.col("none"), F.col("doc_id")).alias("keep_id"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = checkpointed(content_keys(docs).withColumn("row", F.monotonically_increasing_id()))
    index = CuckooIndex(docs.sparkSession, max(1, -(-keys.count() // keys_per_bucket)), keys_per_bucket).insert(keys)
    # Of repeated rows with the kept doc_id and as many code points, the first is the one that stays.
    held = salted_join(keys, index.live().withColumnRenamed("points", "most"), ["digest"], "row")
    twice = (
        held.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most")))
        .groupBy("digest")
        .agg(F.min("row").alias("kept_row"))
    )
    kept = held.join(twice.select(F.col("kept_row").alias("row"), F.lit(True).alias("kept")), "row", "left")
    return kept.select("doc_id", "keep_id", "group_size", F.coalesce("kept", F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM keyed
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""
