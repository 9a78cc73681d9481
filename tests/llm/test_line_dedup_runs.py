import random

import pytest
from oracle import same, views
from pyspark.sql import functions as F

from tidejoin.llm import line_dedup as R
from tidejoin.llm import registry

SF = "/root/testdata/sf0.01"


def brute(texts, least):
    """By comparing all places: the maximal runs that an earlier place has too."""
    docs = {d: [x.rstrip() for x in t.split("\n")] for d, t in texts.items()}
    places = [(d, i) for d in sorted(docs) for i in range(len(docs[d]))]

    def shared(a, b):
        x, y, n = docs[a[0]][a[1] :], docs[b[0]][b[1] :], 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    longest = {p: max((shared(p, q) for q in places if q < p), default=0) for p in places}
    out = {d: [] for d in docs}
    for d, i in places:
        n = longest[d, i]
        if n and longest.get((d, i - 1), 0) <= n and sum(len(x.split()) for x in docs[d][i : i + n]) >= least:
            held = [q for q in places if shared((d, i), q) >= n]
            out[d].append((i, n, *held[0], len(held)))
    return out


@pytest.mark.parametrize("least", [1, 5])
def test_runs_by_brute_force(spark, least):
    draw = random.Random(3)
    texts = {d: "\n".join(draw.choice(["a", "b c", "", "d e f "]) for _ in range(draw.randrange(1, 12))) for d in range(1, 14)}
    texts |= {20: "\n".join(["same"] * 13), 21: "\n".join(["same"] * 9 + ["end"]), 22: texts[3] + "\nalone\n" + texts[5], 23: ""}
    texts |= {30 + k: "\n".join(f"line {i}" for i in range(21)) for k in range(5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts, least)
    for r in R.line_dedup(docs, min_words=least).collect():
        assert [tuple(x) for x in r.runs] == want[r.doc_id], r.doc_id
        assert r.removed == sorted({i for at, n, *_ in want[r.doc_id] for i in range(at, at + n)})


def test_all_levels_are_built(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    levels = R.suffix_levels(R.sequences(docs))
    longest = R.later_copies(R.sequences(docs)).agg(F.max("n")).first()[0]
    assert len(levels) > 1 and longest > 1 and 2 ** (len(levels) - 1) <= longest < 2 ** len(levels)


def test_repeated_rows_and_null_ids_count_once(spark):
    docs = spark.createDataFrame([(1, "x\ny"), (1, "x\ny"), (None, "z\nx\ny"), (None, "z\nw")], "doc_id long, text string")
    runs = [[tuple(x) for x in r.runs] for r in R.line_dedup(docs).collect()]
    # Of the two rows without doc_id, the order of their texts' hashes tells which is first.
    assert sorted(runs) == [[], [], [(0, 1, None, 0, 2)], [(1, 2, 1, 0, 2)]]


@pytest.mark.parametrize("name", ["op8_line_dedup", "op8_line_dedup_50_words"])
def test_runs_same_as_sql(spark, name):
    ok, what = same(registry.QUERIES[name](spark, SF), views(SF), registry.ORACLES[name])
    assert ok, what
