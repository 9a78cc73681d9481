"""A training corpus from documents: toxic texts go, repeated line runs go, near copies go, sources are mixed to their targets, and the texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets; all but the last return the columns of documents. `run` writes each stage's rows as
Parquet in the folder that all executors share, and reads them again.

Defined results: what the stages' operators define. A document of which line dedup leaves nothing but white space goes with it; one that was empty before stays until the mix,
which takes only documents with words. A document that the mix takes twice has two rows from there on, and rows come in the order of the mix. Empty tables pass through all stages. A third stage
finds fewer near copies than the table has, as line dedup has taken those apart that share whole lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidejoin.llm import line_dedup, mixing, ngram_join, sentencepiece_dropout, toxicity
from tidejoin.llm.common import remainder, shared_folder, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns as op7 does, from the labelled documents that op7 doesn't hold out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, model)


def without_line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_line_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.encode_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_line_copies),
    ("near_duplicates", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: No SQL gives the encoder's pieces; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, for the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
