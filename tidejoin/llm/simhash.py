"""Near copies by 64-bit SimHash, found by multi-index hashing.

A text's shingles of three words are hashed, and a bit of its fingerprint is set if it is set in over half of the hashes. Two fingerprints that differ in at most three bits differ in at most one
bit of their upper or of their lower half. So each fingerprint lies in the bucket of either half's value, and visits the buckets one bit away, the Hamming ball of radius one; of two fingerprints
whose halves differ in a bit, the one without the bit visits the other. Buckets are fetched by shuffled keys; what shares one is verified by the whole distance.

Fingerprints are different ones (a text's copies are one), so a bucket is large only where many different fingerprints share half their bits. Such a bucket is split by the other half in the same way, by
its 16-bit quarters: 48 bits are fixed then, so no part has more than 65,536 residents, whatever the table. Buckets are verified in tiles of blocks; a tile hands on a spanning forest
of its links, a row for a fingerprint, and never the pairs.

Defined results: A-Z count as lower case; words are parted by ASCII white space; a text of one or two words is one shingle, a null or wordless text has fingerprint zero, which is linked like any other;
repeated shingles count each time; a very long text is one fingerprint, of all of it; repeated rows have a row each; a null doc_id counts as the largest; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, components, map_slices, salted_join, table, utf8
from .ngram_join import _roots

WORDS, SEED, DISTANCE = 3, 42, 3
#: Members of a bucket from which it is split by the other half.
LARGE = 4096
#: Members of a block of a bucket; small buckets share a group of about so many.
BLOCK, GROUP = 2048, 4096
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes) -> int:
    """The SimHash of a text, as an unsigned number."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(WORDS, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends, digest = ends[width - 1 :].tolist(), xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(x) for x in utf8(batch.column(1))), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), sign, "doc_id long, fp long")


def _part(fp: Column, start: int, bits: int) -> Column:
    """Bits start to start + bits of a fingerprint, as a number."""
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _ball(value: Column, bits: int) -> Column:
    """The value and those that have one bit more than it."""
    more = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.array_distinct(F.concat(F.array(value), more))


def _dealt(rows: DataFrame, by: list[str], parts: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """(by, part, value, fp) of every bucket that a fingerprint visits, its own first; (by, part, value) of every bucket that has a resident. parts: number, first bit, bits."""
    each = lambda values: F.explode(F.array(*(F.struct(F.lit(n).alias("part"), values(start, bits).alias("values")) for n, start, bits in parts))).alias("at")
    visits = rows.select(*by, "fp", each(lambda start, bits: _ball(_part(F.col("fp"), start, bits), bits)))
    visits = visits.select(*by, F.col("at.part").alias("part"), F.explode("at.values").alias("value"), "fp")
    homes = rows.select(*by, each(lambda start, bits: _part(F.col("fp"), start, bits)))
    return visits, homes.select(*by, F.col("at.part").alias("part"), F.col("at.values").alias("value")).distinct()


def _met(rows: DataFrame, by: list[str], parts: list[tuple[int, int, int]]) -> DataFrame:
    """by, part, value, fp, size: members of the buckets that have a resident and at least two members."""
    visits, homes = _dealt(rows, by, parts)
    key = [*by, "part", "value"]
    there = checkpointed(salted_join(visits, homes, key, "fp", how="left_semi"), 200_000)
    sizes = there.groupBy(key).agg(F.count("*").alias("size")).where("size > 1")
    return salted_join(there, sizes, key, "fp")


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    """rows: bucket, block, i, j, fp of one group; a row (u, v) for each fingerprint that has links here, v its part's first."""
    rows = rows.sort_values(["bucket", "fp"])
    bucket, fp, block = rows["bucket"].to_numpy(), rows["fp"].to_numpy(), rows["block"].to_numpy()
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    near = lambda a, b: np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE
    found = []
    if i == j:
        step, left = 1, np.arange(len(fp) - 1)
        # Pairs `step` apart in the same bucket; buckets that have no further pair drop out.
        while len(left := left[left + step < len(fp)]):
            left = left[bucket[left] == bucket[left + step]]
            hit = left[near(fp[left], fp[left + step])]
            found.append(np.stack([hit, hit + step], axis=1))
            step += 1
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for at in range(0, len(left), 256):
            a, b = np.nonzero(near(fp[left[at : at + 256], None], fp[right]))
            found.append(np.stack([left[at + a], right[b]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    # A fingerprint may be in many of the group's buckets: it is one node.
    nodes, node = np.unique(fp, return_inverse=True)
    root = _roots(len(nodes), node[pairs])
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[linked], "v": nodes[root[linked]]})


def links(prints: DataFrame, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """u, v: links between different fingerprints (fp, each once) that connect all that are at most three bits apart, and no others."""
    halves = [(0, 0, 32), (1, 32, 32)]
    met = checkpointed(_met(prints, [], halves), 200_000)
    small = met.where(F.col("size") <= large).select(F.struct("part", "value", F.lit(-1).alias("part2"), F.lit(-1).cast("long").alias("value2")).alias("bucket"), "fp", "size")
    hot = met.where(F.col("size") > large).select(F.col("part").alias("half"), F.col("value").alias("half_value"), "fp")
    split = [
        _met(hot.where(F.col("half") == half), ["half", "half_value"], [(0, start, 16), (1, start + 16, 16)])
        for half, start in ((0, 32), (1, 0))
    ]
    split = split[0].unionByName(split[1]).select(F.struct(F.col("half").alias("part"), F.col("half_value").alias("value"), F.col("part").alias("part2"), F.col("value").alias("value2")).alias("bucket"), "fp", "size")
    members = small.unionByName(split).select(F.xxhash64("bucket").alias("bucket"), "fp", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    members = checkpointed(members.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), 200_000)
    bins = max(1, -(-members.where("blocks = 1").count() // GROUP))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = members.select("bucket", "fp", "block", "blocks", other).select("bucket", "fp", "block", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    group = F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(bins))).otherwise(F.col("bucket"))
    tiles = tiles.select("bucket", "fp", "block", "i", "j", group.alias("group"), (F.col("blocks") == 1).alias("single"))
    return tiles.groupBy("single", "group", "i", "j").applyInPandas(_verify, "u long, v long")


def near_copies(docs: DataFrame, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, fp, component_id (the smallest doc_id that links reach, itself included)."""
    prints = checkpointed(fingerprints(docs), 200_000)
    heads = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), 200_000)
    parts = components(links(heads.select("fp"), large, block))
    rooted = checkpointed(heads.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root")), 200_000)
    smallest = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    classes = salted_join(rooted.select("fp", "root"), smallest, ["root"], "fp").select("fp", "component_id")
    return salted_join(prints, classes, ["fp"], "doc_id").select("doc_id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
