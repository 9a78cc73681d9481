from tidejoin.llm import line_dedup as R
from tidejoin.llm.common import checkpointed

SF = "/root/testdata/sf0.001"


def test_small_tables_start_few_jobs(spark):
    """Each job costs the driver a broadcast and threads: a level of small tables takes no shuffle and no broadcast of a side."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines = checkpointed(R.sequences(docs))
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        context.setJobGroup("levels", "")
        levels = R.suffix_levels(lines)
        context.setJobGroup("runs", "")
        R.longest_earlier(levels)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    made, found = (len(tracker.getJobIdsForGroup(x)) for x in ("levels", "runs"))
    assert len(levels) > 2 and made <= 9 * (len(levels) + 1) and found <= 11 * len(levels), (len(levels), made, found)
