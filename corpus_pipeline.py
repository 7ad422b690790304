"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of docs. Between stages the rows
are written as Parquet and read again, so a lost executor never costs more
than its own stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm.common import small_batches, stored, table
from stowage.llm.language import reject_unknown
from stowage.llm.packing import pack
from stowage.llm.simhash import keep_one
from stowage.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below one half."""
    small_batches(spark)
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known main language that covers at least half of their words."""
    small_batches(spark)
    return reject_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: SimHash within 3 bits, or five-word shingles of 0.8 similarity."""
    small_batches(spark)
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    small_batches(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL can express neither the learned stages nor the packing; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
