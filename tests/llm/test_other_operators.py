"""Odd rows, ties and empty tables; SQL covers the rest, see tests/oracle.py."""

import hashlib
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidejoin.llm import exact_dedup as D
from tidejoin.llm import language_id as L
from tidejoin.llm import line_dedup as R
from tidejoin.llm import mixing as M

DOCS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (5, None), (4, ""), (6, " \n"), (7, "é b"), (7, "é b"), (None, "ab"), (8, "x" * 100_000), (9, "x" * 100_000 + " ")]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, digest string")


def test_exact_dedup(spark):
    rows = D.exact_dedup(frame(spark)).collect()
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, i))
    assert len(rows) == len(DOCS)
    for r in rows:
        assert r.keep_id == min(groups[r.text_sha256])[3] and r.group_size == len(groups[r.text_sha256])
    assert sum(r.kept for r in rows) == len(groups) and all(r.keep_id == r.doc_id for r in rows if r.kept)
    assert D.exact_dedup(frame(spark).limit(0)).count() == 0


def test_cuckoo_filter():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    known = D.CuckooFilter(4)
    assert not all(known.insert(k) for k in keys)  # overflows
    known = D.CuckooFilter.grown(keys, 4)
    known = D.CuckooFilter.read(bytes(known))
    assert all(k in known for k in keys)
    assert sum(hashlib.sha256(b"-%d" % i).digest() in known for i in range(5000)) < 50
    assert all(known.delete(k) for k in keys[:2500]) and all(k in known for k in keys[2500:])
    assert sum(k in known for k in keys[:2500]) < 50


def test_index_inserts_and_deletes(spark):
    """Against a plain list of the live documents; buckets are split on the way."""
    docs = spark.createDataFrame([(i, f"t{i // 2}" + " " * (i % 3)) for i in range(400)], "doc_id long, text string")
    keys = D.content_keys(docs).persist()

    def check(index, ids):
        want = defaultdict(list)
        for i in ids:
            want[f"t{i // 2}"].append((-len(f"t{i // 2}" + " " * (i % 3)), i))
        got = {r.digest: r for r in index.live().collect()}
        assert len(got) == len(want)
        for text, group in want.items():
            r = got[hashlib.sha256(text.encode()).digest()]
            assert (r.group_size, r.keep_id, -r.points) == (len(group), min(group)[1], min(group)[0])

    index = D.CuckooIndex(spark, 1, keys_per_bucket=30).insert(keys.where("doc_id < 100"))
    check(index, range(100))
    index = index.insert(keys.where("doc_id >= 100"))
    assert index.buckets > 3
    check(index, range(400))
    # The document that stays goes, and the next best stays; what the index lacks changes nothing.
    gone = keys.where("doc_id % 3 = 0 OR doc_id < 50")
    index = index.delete(gone).delete(gone)
    check(index, [i for i in range(400) if i % 3 and i >= 50])
    check(index.insert(keys.where("doc_id < 50")), [i for i in range(400) if i < 50 or i % 3])


def test_step_verifies_hits():
    empty, columns = pd.DataFrame(columns=D.COLUMNS), ["bucket", "digest", "size", "points", "none", "doc_id"]
    state = D._step(empty, pd.DataFrame([(0, b"a" * 32, 1, 3, False, 5)], columns=columns))
    # The same fingerprint and place, but other content: a new key.
    other = b"a" * 31 + b"b"
    state = D._step(state, pd.DataFrame([(0, other, 1, 3, False, 2**62 + 1)], columns=columns))
    assert set(state["digest"].dropna()) == {b"a" * 32, other}
    # More code points stay, then the smaller doc_id, then any before null; the bucket names the one that stays.
    state = D._step(state, pd.DataFrame([(0, other, 1, 3, True, 0), (0, other, 1, 3, False, 2**62 + 2), (0, b"a" * 32, 2, 4, False, 9)], columns=columns))
    kept = {r.digest: (r.size, r.points, r.none, r.doc_id) for r in state.dropna(subset=["digest"]).itertuples()}
    assert kept == {other: (3, 3, False, 2**62 + 1), b"a" * 32: (3, 4, False, 9)}


def test_a_change_writes_the_buckets_that_it_touches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string")
    keys = D.content_keys(docs).persist()
    index = D.CuckooIndex(spark, 30, keys_per_bucket=10).insert(keys)
    written, kept = [], D.checkpointed

    def counted(df, *args):
        out = kept(df, *args)
        if "filter" in out.columns:
            written.append(out.select("bucket").distinct().count())
        return out

    monkeypatch.setattr(D, "checkpointed", counted)
    few = keys.where("doc_id < 3")
    for change in range(D.CHANGES):
        index = index.delete(few) if change % 2 == 0 else index.insert(few)
        assert index.live().count() == (297 if change % 2 == 0 else 300)
    assert written[:-1] == [written[0]] * (len(written) - 1) and written[0] <= 3 and written[-1] == 30


@pytest.mark.parametrize("block_words", [1024, 7])
def test_mixing(spark, block_words):
    rows = [(i, " ".join(["w"] * (i % 23)), f"s{i % 5}" if i % 7 else None) for i in range(400)] + [(None, "a b", "s1"), (3, "a b c", "s9"), (3, "a b c", "s9"), (500, None, "empty")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = M.mix(docs, block_words=block_words).collect()
    assert len(got) == len(rows)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = 1.5 * sum(size.values())
    names = [*sorted(s for s in size if s is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, full = {}, set()
    while True:  # shares, stopped at twice the size, again and again
        free = [s for s in names if s not in full]
        left = total - sum(2 * size[s] for s in full)
        want = {s: 2 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if want[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
        assert all(r.source_size == size[s] for r in got if r.source == s)
    again = M.mix(docs.repartition(3), block_words=block_words).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken, str(r.first_slot), str(r.last_slot))
    assert all((r.first_slot is None) == (r.taken == 0) for r in got)
    # Read in the schedule's order, every source is near its share all along.
    if block_words == 7:
        rows, total = sorted((r.first_slot, str(r.source), min(r.taken, r["size"])) for r in got if r.taken), sum(target.values())
        seen = defaultdict(int)
        for i, (_, source, words) in enumerate(rows):
            seen[source] += words
            so_far = sum(seen.values())
            if so_far < total / 4:
                assert all(abs(seen[str(s)] - so_far * target[s] / total) < 90 for s in names)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert M.mix(docs.limit(0)).count() == 0 and [r.taken for r in M.mix(docs.where("doc_id = 500")).collect()] == [0]


def test_line_dedup_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    short = " ".join(f"v{i}" for i in range(30))
    rows = [(2, f"a\n{long}\nb"), (1, f"c\n{long} \n\nd"), (3, None), (4, ""), (5, f"{short}\n{short}"), (6, f"q\n{short}\n{short}\nr"), (7, f"{short}"), (None, long), (8, long), (8, long)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, d string, n_lines int")
    got = {}
    for r in R.line_dedup(docs, min_words=50).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.removed, r.d))
    assert got[1] == [(rows[1][1], [], "clash")] and got[2] == [("a\nb", [1], "clash")]
    assert got[3] == [(None, [], "clash")] and got[4] == [("", [], "clash")] and got[7] == [(short, [], "clash")]
    assert got[5] == [(rows[4][1], [], "clash")] and got[6] == [("q\nr", [1, 2], "clash")]
    assert got[None] == [("", [0], "clash")] and got[8] == [("", [0], "clash")] * 2
    assert R.line_dedup(docs.limit(0)).count() == 0


def test_language_id(spark):
    import random

    rng = random.Random(1)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    parts = {"aa": ["ba", "ko", "mi"], "bb": ["stra", "kö", "un"]}
    rows = [(i, " ".join(word(parts[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    odd = [(200, None, "aa"), (201, "12 !", "aa"), (202, "", None), (203, "Straköun!", None), (None, "bakomi", "zz")]
    docs = spark.createDataFrame([(*r, 0) for r in rows + odd], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in L.identify(docs, F.col("doc_id") < 80, F.col("doc_id") >= 80).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "bb", "aa"]
    strict = {r.doc_id: r.lang_pred for r in L.identify(docs.union(spark.createDataFrame([(300, "xyzzy qwrtz pfgh", None, 0)], docs.schema)), F.col("doc_id") < 80, F.lit(False), reject=True).collect()}
    assert strict[300] == "und" and strict[81] == "bb"
    assert {r.lang_pred for r in L.identify(docs, F.lit(False), F.lit(False)).collect()} == {"und"}
    assert L.identify(docs.limit(0), F.lit(True), F.lit(True)).count() == 0


def test_models_sum_to_one():
    """After any context, seen or not, the alphabet of all languages and one unseen character have all of the probability."""
    import numpy as np

    models = L.Models({"x": Counter({"abab": 3, "abc": 2, "cab": 1}), "y": Counter({"zz": 4, "zab": 1})})
    alphabet = [*"abcz", L.EDGE, "q"]
    assert models.symbols == len(alphabet)
    for context in ("ab", "a", "zz", "", "cabab", "qq", "zq"):
        total = 0
        for c in alphabet:
            chars = np.frombuffer((L.EDGE * (L.ORDER - 1) + context + c).encode("utf-32-le"), np.uint32)
            total = total + models.probabilities(chars, np.array([len(chars) - 1]))[0]
        assert total == pytest.approx(1)
    p = {w: 2 ** models.log_probabilities([w])[0, 0] for w in ("abab", "abc", "cab", "zz")}
    assert p["abab"] > p["abc"] > p["zz"] and p["cab"] > p["zz"]


def test_calibration():
    """The temperature makes scores as sure as the texts allow; the share that is rejected is near the one asked for."""
    import numpy as np

    rng = np.random.default_rng(0)
    true = rng.integers(0, 2, 2000)
    bits = 3 + rng.normal(0, 0.1, (2000, 2))
    bits[np.arange(2000), true] -= 0.1
    models = L.Models({"a": Counter({"a": 1}), "b": Counter({"b": 1})})
    models.calibrate([["a", "b"][t] for t in true], bits)
    p = 1 / (1 + np.exp((bits[:, 0] - bits[:, 1]) / models.temperature))
    sure = p > 0.8
    assert abs((true[sure] == 0).mean() - p[sure].mean()) < 0.05
    own = bits[true == 0, 0]
    assert (own > models.calibration[0]).mean() < 0.005


def test_language_of_held_out_documents(spark):
    """All held-out documents of sf0.01 with their language, and few rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = L.remainder("doc_id", 4)
    got = L.identify(docs, part != 2, part == 2).where("held_out AND lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.99
    assert sum(not r.accepted for r in got) / len(got) < 0.05


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", " ".join(f"w{k % 5000} wo" for k in range(60_000)) + f" {i}", "x") for i in range(4)], "doc_id long, source string, text string, lang string")
    assert {r.lang_pred for r in L.identify(docs, F.lit(True), F.lit(False)).collect()} == {"x"}
    assert R.line_dedup(docs).count() == 4 and sum(r.taken for r in M.mix(docs).collect()) > 400_000
