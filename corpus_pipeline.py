"""From raw documents to packed training sequences: each stage's result is written as Parquet and read as the next one's.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``documents``; each works on all rows that
its predecessor kept. SQL cannot express the fitted stages, so there is no ``ORACLE_SQL``; tests compare the stages with
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buildlens.llm import curve_pack, evidence_language, line_crf, ngram_join, superkmer
from buildlens.llm.common import stored, table

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence names."""
    return evidence_language.accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly good; fitted on the labels that are not held out."""
    return line_crf.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies."""
    return ngram_join.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that occur elsewhere too."""
    return superkmer.cleaned(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids, like documents together."""
    return curve_pack.packed_digests(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
