"""The corpus pipeline: quality, near-duplicates, secrets, packing, each stage over all that the one before kept.

ORACLE_SQL is None: a trained classifier, near-duplicates and tokenization are beyond SQL; the tests compare the
pipeline's rows with brute-force versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmine.llm import minhash, packing, quality, secrets
from quillmine.llm._shared import table
from quillmine.scratch import Scratch

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of the documents that are there.

    Null and empty texts are scored like others, null doc_ids too; rows that repeat are judged each (and alike); without
    labels nothing is rejected; an empty table stays empty; other columns pass through.
    """
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id: shingles of five words, a similarity of 0.8 or more.

    Texts that are null or without words, and rows with a null doc_id, stay; rows that repeat doc_id and text are one; an
    empty table stays empty; other columns pass through.
    """
    return minhash.keep_one(docs, size=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced in their texts, n_chars following.

    Null texts stay null; rows that repeat stay; an empty table stays empty; other columns pass through.
    """
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences.

    Null texts count as empty (one piece with the end id), null doc_ids stay null, rows that repeat are packed each, and an
    empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
