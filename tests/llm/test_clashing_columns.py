"""Every operator over documents with columns of its own names, and of names that DDL and dots can't hold: the rows are those without these columns."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidejoin.llm import brown_lm, collocations, exact_dedup, language_id, licenses, line_dedup, mixing, ngram_join, sentencepiece_dropout, simhash, source_divergence, toxicity
from tidejoin.llm.common import remainder

NAMES = ["row", "doc", "d", "h", "n", "order", "slot", "part", "key", "node", "text_1", "size", "term", "phrase", "fp", "words", "count", "score", "block", "my col", "a-b", "a.b"]
BASE = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    lines = ["One common line of seven words here", "another line", "mit license", "you are a fool", "the same again and again"]
    rows = [(i, "\n".join([f"Text number {i} has words {'x ' * (i % 5)}of its own, {i * 7 % 11}", *(lines[j] for j in range(5) if i >> j & 1)]), ("en", "de")[i % 2], f"s{i % 3}", 50) for i in range(40)]
    rows += [(50 + i, rows[i][1] + (" end" if i % 2 else ""), "en", "s0", 50) for i in range(8)] + [(60, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").persist()


def wide(docs):
    # All 1, as a row number that is one would be wrong for all rows.
    return docs.select("*", *(F.lit(1).cast("long").alias(c) for c in NAMES))


def comparable(rows):
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(repr([plain(v) for v in r]) for r in rows)


def _toxicity(docs):
    labels, part = docs.sparkSession.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(40)], "doc_id long, quality int, toxic int"), remainder("doc_id", 5)
    return toxicity.score_documents(docs, toxicity.fit(docs, labels, part != 0), part == 0)


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "near_duplicates": lambda docs: ngram_join.near_duplicates(docs),
    "mix": lambda docs: mixing.mix(docs).drop("row"),
    "line_dedup": lambda docs: line_dedup.line_dedup(docs).select("doc_id", "text", "n_lines", "removed"),
    "licenses": licenses.scan_licenses,
    "divergence": source_divergence.divergence,
    "collocations": collocations.collocations,
    "simhash": simhash.near_copies,
    "toxicity": _toxicity,
    "brown_lm": lambda docs: brown_lm.score(docs, remainder("doc_id", 5) != 1, remainder("doc_id", 5) == 1),
    "language_id": lambda docs: language_id.identify(docs, remainder("doc_id", 4) != 2, remainder("doc_id", 4) == 2),
    "sentencepiece": sentencepiece_dropout.encode_documents,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(docs, name):
    want = comparable(OPERATORS[name](docs).collect())
    assert want and comparable(OPERATORS[name](wide(docs)).collect()) == want


def test_mixing_takes_no_more_than_twice(docs):
    for r in mixing.mix(wide(docs)).collect():
        assert 0 <= r.taken <= 2 * r.size


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide(docs), str(tmp_path))
        assert out.columns == [*BASE, *NAMES], name
        rows = out.collect()
        assert rows and all(tuple(r)[len(BASE) :] == (1,) * len(NAMES) for r in rows), name
        quoted = [F.col(f"`{c}`") for c in BASE]
        assert comparable(out.select(*quoted).collect()) == comparable(stage(spark, docs, str(tmp_path)).collect()), name
