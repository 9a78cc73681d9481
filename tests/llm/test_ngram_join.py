import random

import pytest
from pyspark.sql import functions as F

from tidejoin.llm import ngram_join as J
from tidejoin.llm.common import components


def brute(docs, n=5, t=0.8):
    def grams(text):
        w = (text or "").split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams(x) for _, x in docs]
    near = [[j for j in range(len(docs)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9] for i in range(len(docs))]
    seen = {}
    for i in range(len(docs)):
        todo = [i] if i not in seen else []
        part = []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = i
                part.append(x)
                todo += near[x]
    least = {}
    for i, (d, _) in enumerate(docs):
        least[seen[i]] = min(least.get(seen[i], d), d)
    return sorted((d, least[seen[i]], len(near[i])) for i, (d, _) in enumerate(docs))


def make(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(60)]
    docs = []
    for b in base:
        docs.append(" ".join(b))
        for _ in range(rng.choice([0, 0, 1, 4])):
            c = list(b)
            for _ in range(rng.choice([0, 1, 2, 4])):
                c[rng.randrange(len(c))] = rng.choice(words)
            docs.append(rng.choice([" ", "\n"]).join(c))
    hub = base[-1] + [rng.choice(words) for _ in range(150)]
    for _ in range(60):  # a large group of near copies
        c = list(hub)
        c[rng.randrange(len(c))] = rng.choice(words)
        docs.append(" ".join(c))
    docs += ["one", "one", "one two", "", " ", "\n"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [256, 16])
def test_against_brute_force(spark, block):
    docs = make()
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, class_id string").repartition(5)
    rows = J.near_duplicates(frame, block=block).collect()
    assert sorted((r.d, r.class_id, r.n_links) for r in rows) == brute(docs)
    assert sorted(r.d for r in rows if r["first"]) == sorted({r.class_id for r in rows})


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (5, None), (6, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.d, r.class_id, r.n_links, r["first"]) for r in J.near_duplicates(frame).collect())
    assert got == [(3, 3, 2, False), (3, 3, 2, True), (4, 4, 0, True), (5, 5, 0, True), (6, 6, 0, True), (J.NULL_ID, 3, 2, False)]
    kept = J.without_near_duplicates(frame).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 5, 6]
    assert J.near_duplicates(frame.limit(0)).count() == 0


def test_bands():
    b, r = J.bands_for()
    assert b * r <= 256 and 1 - (1 - 0.8**r) ** b >= 0.99


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100 + i, 100) for i in range(1, 40)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame(edges, "u long, v long").where(F.lit(False))).count() == 0
