"""Against fingerprints bit by bit and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidejoin.llm import simhash as H

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints):
    """Component of each of the fingerprints, by all pairs."""
    fps = sorted(set(prints))
    x = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    return {fp: find(i) for i, fp in enumerate(fps)}


def hold(rows, want):
    """rows of near_copies against (doc_id, text)."""
    prints = [plain(t) for _, t in want]
    part = classes(prints)
    least = {}
    for (i, _), fp in zip(want, prints):
        least[part[fp]] = min((x for x in (least.get(part[fp]), i) if x is not None), default=None)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in rows), key=key) == sorted(((i, fp, least[part[fp]]) for (i, _), fp in zip(want, prints)), key=key)


def test_odd_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    long = [rng.choice(words) for _ in range(300)]
    near = [" ".join([*long[:i], "other", *long[i + 1 :]]) for i in range(0, 300, 25)]
    texts = [None, "", " \n\t", "one", "One", "one two", "a\x0bb\x0cc", "é À z", " ".join(long), *near, "x y z " * 20_000, "a b c a b c a b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "one"), (None, "alone and without a number")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").withColumn("a.b c", F.lit("x"))
    hold(H.near_copies(docs).collect(), rows)
    assert H.near_copies(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    hold(H.near_copies(docs).collect(), rows)


@pytest.mark.parametrize("large, block", [(4096, 2048), (4096, 7), (20, 2048), (20, 5)])
def test_links(spark, large, block):
    """Random fingerprints, and clusters whose members share half their bits or all but a few: buckets whole, in tiles, split by the other half, and both."""
    rng = np.random.default_rng(5)
    flips = lambda n, bits: [int(sum(1 << int(b) for b in rng.choice(bits, n, replace=False)))]
    prints = [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)]
    for bits in (range(64), range(32), range(32, 64), range(28, 36)):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        prints += [centre ^ flips(int(rng.integers(0, 7)), list(bits))[0] for _ in range(80)]
    prints += [0, 2**64 - 1, 7, 2**63, 2**63 + 2**31, 1 + 2**32 + 2**33]
    prints = sorted(set(prints))
    part = classes(prints)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    found = [(r.u % 2**64, r.v % 2**64) for r in H.links(spark.createDataFrame(signed, "fp long"), large, block).collect()]
    assert all(part[u] == part[v] for u, v in found)
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in found:
        root[find(u)] = find(v)
    assert len({find(x) for x in prints}) == len(set(part.values()))
    assert len(found) < 70 * len(prints)  # forests, not pairs
