from tidejoin.llm import line_dedup as R
from tidejoin.llm.common import checkpointed

SF = "/root/testdata/sf0.001"


def test_few_tasks_and_no_text_twice(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines = checkpointed(R.sequences(docs))
    made, kept = [], R._kept
    monkeypatch.setattr(R, "_kept", lambda df, most: made.append((kept(df, most), most)) or made[-1][0])
    levels = R.suffix_levels(lines)
    R.longest_earlier(levels)
    # The bounds hold, and small tables are made by one task, not by one for each partition of a shuffle.
    assert len(made) > 2 * len(levels) and all(table.n == table.rows.count() <= most for table, most in made)
    assert all(table.rows.rdd.getNumPartitions() == 1 for table, most in made if most <= R.TASK_ROWS)
    assert R.cut_lines(docs).schema["doc"].dataType.names == ["doc_id"]
