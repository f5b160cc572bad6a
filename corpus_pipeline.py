"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Null and empty texts have no language and go with the first stage, as do rows without doc_id; later stages, called alone, keep
null texts. Rows that repeat are judged alike. An empty table gives no rows; other columns are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from residua.llm import common, decontaminate, jaccard, language, lines, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in; others go."""
    return language.stage(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that another document or place has first; a document left without text goes."""
    return lines.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.stage(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span of ten words with a benchmark item, nor hold a shorter item whole."""
    return decontaminate.stage(spark, docs, sf_dir)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 ids."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]
#: Language ID, line dedup and packing can't be expressed in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
