"""Against sums over all terms of all pairs, with Python's integers."""

import re
from collections import Counter, defaultdict

import pytest
from oracle import same, views
from pyspark.sql import functions as F

from tidejoin.llm import source_divergence as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 10]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            parts = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s], "term": [(-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= 10]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "text string, lang string, source string, n int, p double").withColumn("a.b", F.lit(1))


def hold(spark, rows):
    assert sorted(map(tuple, S.divergence(frame(spark, rows)).collect())) == plain(rows)


def test_odd_rows(spark):
    rows = [(f"Alpha beta{'x' * (i % 3)} ÉTÉ été {'gamma ' * i}", "en", f"s{i % 4}") for i in range(40)]
    rows += [("alpha 12 -- ", "en", "s9"), (None, "en", "s8"), ("alpha", None, None), (None, None, "a"), ("", "de", "only"), ("same " * 3, "fr", "b"), ("", "fr", "a")]
    rows += [("common Ünïcode", "xx", s) for s in "ab" for _ in range(6)] + [("common " * 50_000, "xx", "c")]
    hold(spark, rows)


def test_ties_and_one_source(spark):
    hold(spark, [(f"t{chr(97 + i % 15)} z", "en", "one") for i in range(300)])
    hold(spark, [("z a b c d e f g h i j k l m n", "en", "one")] * 12 + [("z", "en", "two")] * 12)


def test_empty(spark):
    assert S.divergence(frame(spark, [("a", "b", "c")]).limit(0)).count() == 0


def test_large_counts_are_exact(spark):
    n = 10**17 + 3
    row = spark.range(1).select(S.share(F.lit(n), F.lit(3 * n), F.lit(5)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (3 * n + 10)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_collocations"])
def test_same_as_sql(spark, name):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    ok, what = same(e.queries()[name](spark, sf), views(sf), e.oracle_sql()[name])
    assert ok, what
