"""Against counts of every phrase in memory."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidejoin.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            for n in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= 30}
        found = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def hold(spark, rows, top=2000):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "text string, lang string, phrase string, n int").withColumn("a b.c", F.lit(1))
    assert sorted(map(tuple, C.collocations(docs, top).collect())) == plain(rows, top)


def some(seed, size, words=12):
    rng = random.Random(seed)
    each = [f"w{i}" for i in range(words)]
    text = lambda: "".join(rng.choice(each) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for _ in range(size))
    return [(text(), rng.choice(["en", "de", None, ""])) for _ in range(60)]


def test_random_texts(spark):
    rows = some(1, 120)
    hold(spark, rows + rows[:9])
    hold(spark, rows, top=7)


def test_odd_texts(spark):
    rows = [("New York City hall; NEW york city", "en")] * 31 + [("new york", "en")] * 10 + [("É é a a a a a a", None)] * 30
    rows += [(None, "en"), ("", None), (" ,.;", "de"), ("x y " * 40_000, "long"), ("no\x0bbreak\x0cof\rlines " * 30, "cc"), ("a\x1cb c d " * 40, "ws")]
    hold(spark, rows)


def test_overlaps_and_repeats(spark):
    hold(spark, [("a a a a a b", "en")] * 29 + [("b a a", "en")] * 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(docs).count() == 0
    assert C.collocations(spark.createDataFrame([("a b", "en")], docs.schema)).count() == 0


def test_small_filter_and_hands(spark, monkeypatch):
    """A filter that lets everything through and tasks that hold few phrases change nothing."""
    monkeypatch.setattr(C, "FILTER_BITS", 1)
    monkeypatch.setattr(C, "HELD", 50)
    hold(spark, some(2, 90, words=40))


def test_filter_finds_all_pairs(spark):
    def phrases(pairs, lang, *pieces):
        held = defaultdict(Counter)
        C._add_long(C._pair_filter(spark.createDataFrame(pairs, "lang string, phrase string")))(held, [lang] * len(pieces), [p.encode().split() for p in pieces], [1, 5][: len(pieces)])
        return {(key, phrase.decode()): n for key, own in held.items() for phrase, n in own.items()}

    assert phrases([("en", f"a{i} b{i}") for i in range(500)] + [("é", "ü ß")], "é", "ü ß") == {}
    two = [("en", "a b"), ("en", "b c"), ("é", "ü ß"), ("é", "ß ü")]
    assert phrases(two, "en", "a b c x", "b c a b c") == {(("en", 3), "a b c"): 6}
    assert phrases(two, "é", "ü ß ü ß", "ß ü") == {(("é", 3), "ü ß ü"): 1, (("é", 3), "ß ü ß"): 1, (("é", 4), "ü ß ü ß"): 1}


def test_buckets_larger_than_memory(spark, tmp_path, monkeypatch):
    """A bucket of more than duckdb's memory is counted all the same, and leaves nothing behind."""
    monkeypatch.setattr(C, "MEMORY", "40MB")
    schema = C.pa.schema([("lang", C.pa.string()), ("phrase", C.pa.string()), ("words", C.pa.int32()), ("n", C.pa.int64())])

    def batches():
        for turn in range(30):
            for at in range(0, 400_000, 20_000):
                yield C.pa.record_batch([["en"] * 20_000, [f"a phrase of several words, number {i}" for i in range(at, at + 20_000)], [2] * 20_000, [1] * 20_000], schema=schema)

    found = C.pa.Table.from_batches(list(C._bucket_counts(batches(), str(tmp_path / "spilled"))))
    assert found.num_rows == 400_000 and set(found["n"].to_pylist()) == {30}
    assert not list((tmp_path / "spilled").iterdir())
