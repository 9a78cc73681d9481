from oracle import same, views

from tidejoin.llm import line_dedup as R
from tidejoin.llm import registry

SF = "/root/testdata/sf0.001"


def test_short_runs_count(spark, tmp_path):
    rows = [(1, "a\nnine words\nb"), (2, "c\nnine words\n\nd"), (3, "\n\ne"), (4, "\n\nf\nnine words\n\nd"), (5, None), (None, "e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.removed, r.text) for r in registry.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: ([], rows[0][1]), 2: ([1], "c\n\nd"), 3: ([], rows[2][1]), 4: ([3, 4, 5], "\n\nf"), 5: ([], None), None: ([0], "")}


def test_same_as_sql(spark):
    assert R.ORACLE.count("50") == 0
    ok, what = same(registry.QUERIES["op8_line_dedup"](spark, SF), views(SF), registry.ORACLES["op8_line_dedup"])
    assert ok, what
