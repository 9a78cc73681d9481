import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidejoin.llm import brown_lm as B
from tidejoin.llm.common import remainder

DOCS = [(i, t) for i, t in enumerate([None, "", " \n ", "The cat sat. the CAT", "a b c d e f g a b c", "Ünï çode the the", "x" * 5000 + " the"] + [f"word{i % 7} the cat w{i // 3} a b word{i % 3} v{i}" for i in range(60)])] + [(5, "repeated row"), (None, "no id the")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def tok(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def counted(docs):
    return Counter(w for i, t in docs if not held(i) for w in tok(t))


def brute(docs):
    c = counted(docs)
    n, v = sum(c.values()), len(c)
    return sorted((-1 if i is None else i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 6)) for i, t in docs)


def brute_scores(docs, core, classes, least=2):
    """The model, word by word."""
    c = counted(docs)
    training = [tok(t) for i, t in docs if not held(i)]
    key = lambda w: B._key(B.END if w is None else w.encode())
    frequent = sorted(c, key=lambda w: (-c[w], key(w)))[:core]
    unit = {w: i for i, w in enumerate(frequent)}
    n = len(frequent)
    pairs = np.zeros((n + 2, n + 2))
    for ws in training:
        for a, b in zip(["<s>", *ws], ws):
            pairs[n + 1 if a == "<s>" else unit.get(a, n), unit.get(b, n)] += 1
    of = B.exchange(pairs, 2, classes)
    k = int(of[n])
    joint = np.zeros((k + 2, k + 2))
    for i in range(n + 2):
        for j in range(n + 2):
            joint[of[i], of[j]] += pairs[i, j]
    own = {w: int(of[unit[w]]) for w in frequent}
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    for w in c:
        if w in own:
            continue
        own[w] = k
        if c[w] < least:
            continue
        before, after = Counter(), Counter()
        for ws in training:
            classes_of = [k + 1, *(of[unit[x]] if x in unit else k for x in ws)]
            for i, x in enumerate(ws):
                if x == w:
                    before[int(classes_of[i])] += 1
                    if i + 1 < len(ws):
                        after[int(classes_of[i + 2])] += 1
        best = None
        for z in range(k):
            after_z = joint.copy()
            for u, m in after.items():
                after_z[z, u] += m
            for u, m in before.items():
                after_z[u, z] += m
            gain = sum(f(x) for x in after_z.ravel()) - sum(f(x) for x in joint.ravel())
            gain -= f(joint[z].sum() + sum(after.values())) - f(joint[z].sum()) + f(joint[:, z].sum() + sum(before.values())) - f(joint[:, z].sum())
            if best is None or gain > best[0] + 1e-9:
                best = gain, z
        own[w] = best[1]
    size, kinds, moves = np.zeros(k + 2), np.zeros(k + 2), np.zeros((k + 2, k + 2))
    for w, x in c.items():
        size[own[w]] += x
        kinds[own[w]] += 1
    cls = lambda w: own.get(w, k)
    for ws in training:
        for a, b in zip(["<s>", *ws], ws):
            moves[k + 1 if a == "<s>" else cls(a), cls(b)] += 1
    prior = (size + 0.5) / (size + 0.5).sum()
    out = []
    for i, t in docs:
        total = 0.0
        for a, b in zip(["<s>", *tok(t)], tok(t)):
            x, y = k + 1 if a == "<s>" else cls(a), cls(b)
            total += math.log10((moves[x, y] + B.SMOOTH * prior[y]) / (moves[x].sum() + B.SMOOTH)) + math.log10((c[b] + 0.5) / (size[y] + 0.5 * (kinds[y] + 1)))
        out.append((-1 if i is None else i, round(total, 6)))
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 12, 0])
def test_against_brute_force(spark, most):
    """Whatever the head's size: it decides about the way only."""
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id long, text string, token string")
    part = remainder("doc_id", 5)
    rows = B.score(docs, part != 1, part == 1, most, classes=4, core=10).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == brute(DOCS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in rows) == brute_scores(DOCS, 10, 4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(DOCS[:4], "doc_id long, text string")
    rows = B.score(docs, F.lit(False), F.lit(True)).collect()
    assert {(r.train_tokens, r.base_score, r.n_known, r.score) for r in rows} == {(0, 0.0, 0, 0.0)}
    assert B.score(docs.limit(0), F.lit(True), F.lit(True)).count() == 0


def test_probabilities_sum_to_one():
    size, kinds = np.array([5.0, 7.0, 3.0, 0.0]), np.array([2.0, 1.0, 3.0, 0.0])
    model = B.ClassModel(np.array([3, 2, 7]), np.array([0, 0, 1]), size, kinds, 15, 6)
    model.learn(np.arange(16.0).reshape(4, 4))
    assert (10**model.move).sum(axis=1) == pytest.approx(1)
    # Within a class, known tokens and one unseen half share what there is.
    for k, own in ((0, [3, 2]), (1, [7]), (2, [1, 1, 1])):
        assert (10 ** model.emit(np.array(own), np.full(len(own), k))).sum() + 0.5 / model.mass[k] == pytest.approx(1)


def test_head_cuts_ties(spark):
    counts = spark.createDataFrame([(-(i * 2**40) - 1, 5 if i < 3 else 1) for i in range(500)], "token long, c long")
    want = sorted(counts.collect(), key=lambda r: (-r.c, r.token))
    for most in (0, 2, 3, 10, 499, 500, 900):
        token, c = B.head_of(counts, most)
        assert token.tolist() == [r.token for r in want[:most]] and c.tolist() == [r.c for r in want[:most]]


def test_exchange_finds_the_classes():
    # Words 0-4 are followed by 5-9 and these by 0-4, all else equal.
    pairs = np.zeros((10, 10))
    pairs[:5, 5:] = pairs[5:, :5] = 7
    of = B.exchange(pairs, 0, 2)
    assert len(set(of[:5])) == len(set(of[5:])) == 1 and of[0] != of[9]


def test_exchange_ends_at_an_optimum():
    """After it, no single move raises the mutual information."""
    rng = np.random.default_rng(2)
    pairs = np.zeros((32, 32))
    np.add.at(pairs, (rng.integers(0, 32, 900), rng.integers(0, 30, 900)), 1)
    of = B.exchange(pairs, 2, 5)

    def information(of):
        joint = np.zeros((7, 7))
        np.add.at(joint, (np.repeat(of, 32), np.tile(of, 32)), pairs.ravel())
        return B._gain(joint).sum() - B._gain(joint.sum(axis=1)).sum() - B._gain(joint.sum(axis=0)).sum()

    best = information(of)
    for w in range(30):
        for k in range(5):
            other = of.copy()
            other[w] = k
            assert information(other) <= best + 1e-6


def test_classes_lower_perplexity(spark):
    """On the table: held-out texts are likelier under classes than under one class."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    part = remainder("doc_id", 5)
    per = lambda **options: B.score(docs, part != 1, part == 1, **options).where("held_out").agg(-F.sum("score") / F.sum("n_tokens")).first()[0]
    many, one = per(), per(classes=1)
    assert many < one
