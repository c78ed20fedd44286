"""Corpus pipeline: toxic documents go, one document of each near-duplicate group
stays, documents with benchmark passages go, personal data is masked, and what
is left is packed into token windows.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes each
stage's rows to the shared folder and reads them again, so a lost executor
repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.queries import vocabulary
from limnos.llm.runtime import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled documents; keep those predicted clean."""
    from limnos.llm.toxicity import remove_toxic, train

    return remove_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component (Jaccard 0.8 of 5-word shingles)."""
    from limnos.llm.jaccard import keep_one

    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a 10-word window of a benchmark item."""
    from limnos.llm.decontaminate import remove_documents

    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows the text."""
    from limnos.llm.pii import redact

    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of at most 1024 ids: one row per piece, with its ids."""
    from limnos.llm.packing import pack

    return pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]

#: The classifier is trained, so SQL cannot express the rows; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
