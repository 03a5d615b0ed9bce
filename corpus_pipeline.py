"""The corpus pipeline: language ID, near-dedup, PII masking, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of ``documents``, whatever other columns there are. A caller may write
what a stage returns and read it again as the next one's ``docs``; ``run`` does so itself, which
also ends each stage's lineage, and deletes what a stage no longer needs.

Rows that are odd: the language stage drops null texts, empty ones and those without a letter, so
the later stages only meet them when called alone, and then do as their docstrings say. Very
long texts are treated whole everywhere. An empty table gives an empty result in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm._common import drop_tables, materialize, scratch
from voxmill.llm.langid import documents_with_language
from voxmill.llm.mixing import mixed_documents
from voxmill.llm.packing import pack_documents, with_crc
from voxmill.llm.pii import masked_documents
from voxmill.llm.simhash import near_duplicate_representatives


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: those that the classifier calls 'und'.

    Null and empty texts and those without a letter go. Of equal scores the first label wins.
    Repeated rows and null doc_ids are judged one by one by their texts.
    """
    return documents_with_language(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, the one with the least doc_id.

    Of repeated rows any one stays. A null doc_id only stays if its group has no other; texts
    without words (null, empty) are one group.
    """
    return near_duplicate_representatives(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets.

    No row goes; a null text stays null. Of kinds that tie the first listed is named; repeated
    rows and null doc_ids are masked one by one.
    """
    return masked_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw blocks of the sources to their target weights; a document is as long as what was drawn of it.

    A null source is one more source. Null and empty texts have nothing to draw and go. Repeated
    rows and null doc_ids are documents of their own; ties in doc_id are ordered by a hash of the text.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of 1024 tokens; pieces by document with a checksum of their ids.

    A null or empty text is its end id alone. Repeated rows, also with a null doc_id, are packed
    one by one; a long text is cut over several sequences.
    """
    return with_crc(pack_documents(docs))


STAGES = [("language ID", language), ("SimHash near-dedup", dedup), ("PII", pii), ("mixing", mixture), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is lazily returned reads the last table written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            new = materialize(stage(spark, docs, sf_dir), "stage_" + name.split()[0].lower(), keep=True)
        if k:
            drop_tables(spark, docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
