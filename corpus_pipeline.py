"""A corpus pipeline: quality rules, near duplicates, secrets, mixing and packing, each stage over what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isogrid.llm.common import read, stored
from isogrid.llm.mixing import mixed_documents
from isogrid.llm.ngram_join import one_of_each_group
from isogrid.llm.packing import pack
from isogrid.llm.quality import keep_good
from isogrid.llm.secret_scan import redact_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go, null and empty texts among them; repeated rows are judged each by itself."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity of 0.8): that of least id, null ids last.

    Rows that repeat id and text stay once; texts without a word have no copies and stay.
    """
    return one_of_each_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null and empty texts and repeated rows as they are."""
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: a row for each use of a document, the last use of a source cut to its words.

    Null and empty texts have no words to take and go; a null source is one of its own; repeated rows queue each by itself.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; null and empty texts are their end id alone, repeated rows packed each."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Compression, decoding and tokenizing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stage's rows written as Parquet and read back for the next.

    Each stage takes nulls in any column, texts of any length, further columns of any name and empty tables.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
