"""N-gram Jaccard join by MinHash banding.

A document's set is its different word n-grams, as 64-bit hashes. Documents with the same set are one text to the join, which goes on with one of them and
their number. The minima of b * r hash functions over the set make b bands of r; b and r are chosen for the target recall at the threshold.
Band hashes are shuffled; texts that share one are candidates, kept as a star around the smallest text of the band, never as all pairs.

The stars' connected components hold every candidate pair. A small component is one group's work. A large one is cut into blocks of texts that have the smallest text of
their bands in common; each pair of blocks that meet in a band is a group of its own, so no task has more than two blocks, and a long chain of candidates takes what its links
take, not all its pairs. A group computes its texts' full n-gram sets from their whole texts and verifies all its pairs,
by counting common n-grams; it hands on, for each text, its number of links and one link into its linked part, never the pairs. Components over the
verified links are the classes. Only candidates' texts are shuffled: the others are left out where they are read, by a bitmap of the candidates that is 16 MB at most.

Results: class_id is the smallest doc_id of the class; n_links is the number of other documents with a similarity of at least the threshold, those with the same set among them.

Defined results: words are parted by white space; a text of fewer than n words has one n-gram, all its words; a null or wordless text has none and is a class of its own;
rows with the same doc_id and text count as documents each; a null doc_id counts as the largest; a very long text is one set, read whole; an empty table gives an empty result.
Other columns aren't read, and pass through `without_near_duplicates` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, components, map_slices, possible, salted_join, table, utf8, whole_rows

N = 5
THRESHOLD = 0.8
RECALL = 0.99
HASHES = 256
#: Texts in a block of a large component; texts that share a group if their components are small.
BLOCK = 256
NULL_ID = 2**63 - 1
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with most rows such that a pair at the threshold shares a band with probability `recall` or more."""
    fit = [(hashes // r, r) for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    return max(fit, key=lambda x: x[1]) if fit else (hashes, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: bytes, n: int = N) -> np.ndarray:
    """The sorted hashes of a text's different word n-grams."""
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), np.uint64)
    if not len(words):
        return words
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = _mix(out + words[i : len(words) - width + 1 + i] * ODD[i % 5] + np.uint64(i))
    return np.unique(out)


def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, hashes, dtype=np.uint32)


def minima(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, (x[at : at + 2048, None] * a + b).min(axis=0))
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """d (doc_id), h (a hash of the text), key (of the set; null without words), bands."""
    a, b = _functions(bands * rows)
    power = np.random.default_rng(7).integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, hashes = [], []
        for text in utf8(batch.column(2)):
            grams = ngrams(text, n)
            keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
            own = _mix((minima(grams, a, b).reshape(bands, rows).astype(np.uint64) * power).sum(axis=1) + np.arange(bands, dtype=np.uint64))
            hashes.append(own.view(np.int64) if len(grams) else np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*hashes, np.zeros(0, np.int64)])))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), lists], ["d", "h", "key", "bands"])

    return map_slices(_keyed(docs).select("d", "h", "text"), sign, "d long, h long, key binary, bands array<long>")


def _keyed(docs: DataFrame, what: str = "text") -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), (text if what == "text" else F.col(what)).alias(what))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets `left` (rows) and `right` (columns) have a Jaccard similarity of at least the threshold."""
    sizes = np.array([len(x) for x in sets])
    grams = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), sizes)
    _, gram, often = np.unique(grams, return_inverse=True, return_counts=True)
    # An n-gram of a single set is common to no pair.
    shared = often[gram] > 1
    own, gram = own[shared], np.unique(gram[shared], return_inverse=True)[1]
    order = np.argsort(gram, kind="stable")
    own, gram = own[order], gram[order]
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    last = int(gram[-1]) + 1 if len(gram) else 0
    for at in range(0, last, 4096):
        i, j = np.searchsorted(gram, [at, at + 4096])
        part, of = gram[i:j] - at, own[i:j]
        a, b = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        a[row[of[row[of] >= 0]], part[row[of] >= 0]] = 1
        b[column[of[column[of] >= 0]], part[column[of] >= 0]] = 1
        common += a @ b.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= threshold * union - 1e-6


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n things, the first of its part under the given links."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        root = root[root]
        if (root == before).all() and (root[pairs[:, 0]] == root[pairs[:, 1]]).all():
            break
    return root


def _verify(rows: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """rows: node, copies, root, block, i, j, text. For each text: node, links, to (a node of its linked part), of this group's pairs."""
    out = []
    for _, own in rows.drop_duplicates("node").groupby("root", sort=False):
        own = own.sort_values("node")
        sets = [ngrams(t.encode("utf-8", "surrogatepass"), n) for t in own["text"]]
        i, j = int(own["i"].iloc[0]), int(own["j"].iloc[0])
        block, nodes, copies = own["block"].to_numpy(), own["node"].to_numpy(), own["copies"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            continue
        hit = linked(sets, left, right, threshold)
        links = np.zeros(len(own), np.int64)
        if i == j:
            np.fill_diagonal(hit, False)
        links[left] += hit @ copies[right]
        if i != j:
            links[right] += hit.T @ copies[left]
        a, b = np.nonzero(hit)
        root = _roots(len(own), np.stack([left[a], right[b]], axis=1))
        out.append(pd.DataFrame({"node": nodes, "links": links, "to": nodes[root]}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "to": []}, dtype="int64")


def candidates(texts: DataFrame) -> DataFrame:
    """node, root: texts (node, bands) that share a band with another, by connected component of shared bands."""
    members = texts.select("node", F.explode("bands").alias("band"))
    bands = members.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size")
    stars = salted_join(members, bands, ["band"], "node", salts=4).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    return components(stars)


def tiles_of(texts: DataFrame, placed: DataFrame, block: int) -> DataFrame:
    """The columns of placed, with block, i, j and group, for the texts of large components: a row for each pair (i, j) of blocks that its own block is in, of those that share a band.

    Texts with the same centre (the smallest text that one shares a band with) make blocks of their own if they are many, and share some otherwise.
    """
    members = texts.join(placed.select("node", "root", "blocks"), "node").select("node", "root", "blocks", F.explode("bands").alias("band"))
    shared = members.groupBy("root", "band").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size")
    met = checkpointed(salted_join(members, shared, ["root", "band"], "node", salts=4), 200_000)
    centres = met.groupBy("node", "root", "blocks").agg(F.min("least").alias("centre"))
    often = centres.groupBy("root", "centre").agg(F.count("*").alias("often"))
    many = F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.ceil(F.col("often") / block)))
    few = F.xxhash64("root", F.pmod(F.xxhash64("centre"), F.col("blocks")), F.lit("few"))
    cut = F.when(F.col("often") >= block, many).otherwise(few).alias("block")
    cut = checkpointed(salted_join(centres, often, ["root", "centre"], "node").select("node", cut), 200_000)
    seats = met.join(cut, "node").select("root", "band", "block").distinct()
    i, j = (seats.withColumnRenamed("block", x) for x in "ij")
    pairs = checkpointed(i.join(j, ["root", "band"]).where("i <= j").select("root", "i", "j").distinct())
    sides = pairs.withColumn("block", F.col("i")).unionByName(pairs.where("i < j").withColumn("block", F.col("j")))
    return placed.join(cut, "node").join(sides, ["root", "block"]).withColumn("group", -1 - F.col("root"))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """A row per document: d and h (its doc_id, null as the largest long, and text hash), class_id, n_links, first (whether it is its class's first)."""
    b, r = bands_for(threshold, recall)
    signed = checkpointed(signatures(docs, n, b, r).withColumn("row", F.monotonically_increasing_id()))
    # One text for each set.
    first = F.min(F.struct("d", "row", "h")).alias("first")
    texts = checkpointed(
        signed.where("key IS NOT NULL").groupBy("key").agg(first, F.count("*").alias("copies"), F.first("bands").alias("bands"))
        .select("key", F.col("first.row").alias("node"), F.col("first.d").alias("d"), F.col("first.h").alias("h"), "copies", "bands")
    )
    roots = candidates(texts)
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    placed = salted_join(roots, sizes, ["root"], "node").join(texts.select("node", "d", "h", "copies"), "node")
    placed = checkpointed(placed.withColumn("blocks", F.ceil(F.col("size") / block)))
    bins = max(1, -(-placed.where("blocks = 1").count() // block))
    # Small components share groups.
    zero = F.lit(0).cast("long")
    small = placed.where("blocks = 1").withColumns({"block": zero, "i": zero, "j": zero, "group": F.pmod(F.xxhash64("root"), F.lit(bins))})
    tiles = small.unionByName(tiles_of(texts, placed.where("blocks > 1"), block)).select("node", "copies", "root", "block", "i", "j", "group", "d", "h")
    # A row for each doc_id and text that may be a candidate's; repeats go before the shuffle.
    own = possible(_keyed(docs), placed, ["d", "h"]).groupBy("d", "h").agg(F.first("text").alias("text"))
    tiles = tiles.join(own, ["d", "h"]).drop("d", "h")
    checked = checkpointed(tiles.groupBy("group", "i", "j").applyInPandas(lambda rows: _verify(rows, n, threshold), "node long, links long, to long"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(checked.select(F.col("node").alias("u"), F.col("to").alias("v")))
    # Classes of texts, then of documents.
    known = texts.select("key", "node", "d", "copies").join(links, "node", "left").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A text without a link and a copy is a class of its own, as one without words.
    known = checkpointed(known.select("key", "node", "d", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0"))
    classes = known.groupBy("root").agg(F.min(F.struct("d", "node")).alias("head"))
    known = salted_join(known, classes, ["root"], "node").select("key", "n_links", F.col("head.d").alias("class_id"), F.col("head.node").alias("head"))
    out = salted_join(signed.select("d", "h", "row", "key"), known, ["key"], "row", how="left")
    return out.select("d", "h", F.coalesce("class_id", "d").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("head", "row") == F.col("row")).alias("first"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which each is its class's first; columns stay. Of rows with the same doc_id and text, the one with the smallest hash of all columns does."""
    kept = near_duplicates(docs.select("doc_id", "text")).where("first").select("d", "h")
    comparable = [F.col(f"doc.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = _keyed(docs.select("doc_id", "text", whole_rows(docs)), "doc").withColumn("order", F.xxhash64(*comparable))
    once = F.row_number().over(Window.partitionBy("d", "h").orderBy("order"))
    # Repeated rows go before the shuffle, by the window's limit.
    return keyed.withColumn("n", once).where("n = 1").join(kept, ["d", "h"], "left_semi").select("doc.*")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    whole = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(whole("d").alias("doc_id"), whole("class_id").alias("class_id"), "n_links", "first")
