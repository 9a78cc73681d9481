import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Row

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline as P  # noqa: E402
from test_ngram_join import brute as near  # noqa: E402

from tidejoin.llm import line_dedup, mixing, sentencepiece_dropout  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        out.append([r.asDict() for r in docs.collect()])
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, [r.asDict() for r in docs.collect()]]


def sql(docs, query):
    import pandas as pd

    documents = pd.DataFrame(docs)  # noqa: F841
    return duckdb.sql(query).fetchall()


def test_columns_and_toxic(stages, spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first, second = ({r["doc_id"] for r in stages[k]} for k in (0, 1))
    assert all(set(r) == set(stages[0][0]) for k in range(1, 5) for r in stages[k])
    assert second <= first and not any(labels.get(i) == 0 for i in first - second)


def test_lines(stages):
    before = {r["doc_id"]: r["text"] for r in stages[1]}
    want = {r[0]: r[4] for r in sql(stages[1], line_dedup.ORACLE) if r[4] is None or r[4] == before[r[0]] or r[4].strip(" \t\n\v\f\r")}
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want


def test_near_copies(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[2]]
    assert sorted(r["doc_id"] for r in stages[3]) == sorted({c for _, c, _ in near(docs)})


def test_mix(stages):
    rows = stages[3]
    assert {r["doc_id"] for r in stages[4]} <= {r["doc_id"] for r in rows}
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}
    want = {r[0]: r[3] for r in sql([{"source": r["source"], "doc_id": r["doc_id"], "text": r["text"]} for r in rows], f"SELECT source, sum(source_size), count(*), any_value(target) FROM (SELECT m.*, d.source FROM ({mixing.ORACLE}) m JOIN documents d USING (doc_id)) GROUP BY source")}
    got = defaultdict(int)
    for r in stages[4]:
        got[r["source"]] += size[r["doc_id"]]
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 2
    largest = max(size.values())
    assert all(abs(got[s] - t) <= largest for s, t in want.items())


def test_mix_is_in_the_order_of_the_schedule(stages):
    """Within the first quarter of the rows, each source has about its share of all words of the mix."""
    words = [(r["source"], len(r["text"].split())) for r in stages[4]]
    total, quarter = defaultdict(int), defaultdict(int)
    for i, (s, n) in enumerate(words):
        total[s] += n
        quarter[s] += n * (i < len(words) // 4)
    largest = max(n for _, n in words)
    for s in total:
        assert abs(quarter[s] - total[s] * sum(quarter.values()) / sum(total.values())) < 6 * largest


def test_columns_with_the_operators_own_names(spark, tmp_path):
    names = ["_d", "_h", "_n", "_times", "_copy", "n_lines", "removed", "rest", "d", "h", "row", "doc", "slot", "part", "taken", "n", "order"]
    rows = [(i, f"some words of text {i} here\nline {i}", "en", f"s{i % 2}", 20, *(f"{c}{i}" for c in names)) for i in range(12)]
    rows += [(100, rows[0][1], "en", "s0", 20, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) >= 12 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names if r.doc_id != 100), name


def test_pieces(stages):
    vocabulary = sentencepiece_dropout.Vocabulary(sentencepiece_dropout.default_model())
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    import numpy as np

    assert all(r["lossless"] and vocabulary.decode(np.array(r["ids"])) == text[r["doc_id"]] for r in stages[5])


def test_odd_rows(spark, tmp_path):
    odd = [Row(doc_id=None, text=None, lang=None, source=None, n_chars=None), Row(doc_id=1, text="", lang="en", source="a", n_chars=0), Row(doc_id=2, text="x y", lang="en", source="a", n_chars=3)] + [Row(doc_id=2, text="x y", lang="en", source="a", n_chars=3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, rows in (("odd", odd), ("none", [])):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
        assert {r.doc_id for r in docs.collect()} <= {2} and (name == "odd") == (docs.count() > 0)
