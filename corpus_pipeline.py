"""A corpus from documents to packed sequences: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinsieve.llm.common import packed, remove_folder, shared_folder, table, unpacked
from kinsieve.llm.linedup import without_repeated_lines
from kinsieve.llm.minhash import one_of_each
from kinsieve.llm.mixing import mix
from kinsieve.llm.packing import pack
from kinsieve.llm.toxicity import fit, held_out, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; labels are learnt as in the query."""
    lexicon = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out())
    return unpacked(score(packed(docs, "text"), lexicon).where("predicted = 0"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; documents that were copies throughout go."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, of five words and 80 per cent as stages on shingles take (the query of operator 6 has a contract of its own)."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Models and hashes are not SQL functions; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written as Parquet to the shared folder and read again.

    A stage's table is deleted when its successor is written.  The last one is what the result reads, so it stays; it
    lies in the checkpoint folder, in a folder of its own.
    """
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{k}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
