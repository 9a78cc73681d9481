"""What a long chain of candidates takes, which texts are shuffled, and recall on the given documents."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute

from tidejoin.llm import ngram_join as J
from tidejoin.llm.common import possible, table


def test_a_chain_takes_what_its_links_take(spark, monkeypatch):
    docs = [(i, " ".join(f"w{x}" for x in range(3 * i, 3 * i + 60))) for i in range(500)]
    seen, tiles_of = [], J.tiles_of

    def counted(*args):
        seen.append(tiles_of(*args))
        return seen[-1]

    monkeypatch.setattr(J, "tiles_of", counted)
    rows = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block=16).collect()
    assert sorted((r.d, r.class_id, r.n_links) for r in rows) == brute(docs)
    blocks = -(-500 // 16)
    tiles = seen[0].select("root", "i", "j").distinct().count()
    # All pairs of blocks would be about 500.
    assert blocks / 2 < tiles < blocks * (blocks + 1) / 2 / 2
    assert max(Counter((r.i, r.j) for r in seen[0].collect()).values()) < 16 * 8


@pytest.mark.parametrize("most", [2**27, 2**15])
def test_possible(spark, most):
    big = spark.range(60_000).select(F.col("id").alias("d"), (F.col("id") * 7).alias("h"), F.lit("x").alias("text"))
    small = big.where("d % 50 = 0").select("h", "d")
    got = possible(big, small, ["d", "h"], most)
    assert got.columns == big.columns
    ids = {r.d for r in got.select("d").collect()}
    assert set(range(0, 60_000, 50)) <= ids and got.count() == len(ids) < 1200 + 60_000 // 20
    assert possible(big, small.limit(0), ["d", "h"]).count() == 0


def test_recall_on_the_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    # Pairs by an inverted list of n-grams, each text's set whole.
    sets, having = {}, defaultdict(list)
    for r in docs.collect():
        w = (r.text or "").split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for g in sets[r.doc_id]:
            having[g].append(r.doc_id)
    links = Counter()
    for a, own in sets.items():
        common = Counter(b for g in own for b in having[g] if b != a)
        links[a] = sum(5 * n >= 4 * (len(own) + len(sets[b]) - n) for b, n in common.items())
    got = {r.d: r.n_links for r in J.near_duplicates(docs).collect()}
    assert got.keys() == sets.keys() and all(n <= links[d] for d, n in got.items())
    assert sum(got.values()) >= 0.99 * sum(links.values()) > 0
