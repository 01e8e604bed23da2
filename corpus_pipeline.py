"""The text pipeline: STAGES over documents, each written as Parquet and read as the next one's input.

All stages but the last return the columns of documents, whatever others there are, and the last one
the corpus: those columns with every document's place in the mix. An empty table passes through every
stage as an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import shared_folder, table
from attestra.llm.decontaminate import keep_clean
from attestra.llm.mixing import mix_corpus
from attestra.llm.near_duplicates import keep_one
from attestra.llm.pii import mask_pii
from attestra.llm.quality_rules import keep_by_rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty and short texts fail; equal rows share a verdict; an id isn't looked at."""
    return keep_by_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    A row without an id is in no group and stays; rows that repeat an id and a text count once. Null
    and empty texts are like no other and stay.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contract allows.

    Null and empty texts hold nothing of it and stay, equal rows share a verdict, and an empty
    benchmark rejects nothing.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars counted anew. A null text stays null."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: every document with its text and the copies (shard, place, words) that the mix takes of it.

    A document that isn't taken has no copies. A null source is a source, null and empty texts have no
    words to take, and rows that repeat an id and a text are one row with the copies of all.
    """
    return mix_corpus(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: The quality stage hashes n-grams with a function that DuckDB lacks; tests hold the stages against brute force.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table in whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; a stage is written to the shared checkpoint folder, and the one before it deleted once it is: at any time two of them exist."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
