"""Corpus preparation: toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Toxic documents
and near copies go; secrets are replaced within the documents that hold them, which stay; the last
stage lays what is left into training windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.packing import pack_documents
from glyphmill.llm.secret_scan import redact_secrets
from glyphmill.llm.shared import Folder
from glyphmill.llm.simhash import drop_near_duplicates
from glyphmill.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced by [REDACTED:kind]."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of related documents: (pack_id, slot, doc_id, start_word, n_words, score)."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: The first stage's models can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of sf_dir; every other stage is kept as Parquet in the
    folder of spark.checkpoint.dir and read again, so that a lost executor costs one stage at most. The
    last stage has written its own rows when it returns, so the others' tables are deleted then."""
    folder = Folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = folder.write(stage(spark, docs, sf_dir), name)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    folder.remove()
    return packed
