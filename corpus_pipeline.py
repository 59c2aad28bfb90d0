"""Cleaning of `documents` in stages that each call one operator of sheetscore.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetscore.llm.common import prepare, written
from sheetscore.llm.decontaminate import drop_contaminated
from sheetscore.llm.language import drop_unidentified, train
from sheetscore.llm.line_dedup import line_dedup
from sheetscore.llm.packing import pack_documents
from sheetscore.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages with a score of 0.3 or more, go (also nulls)."""
    prepare(spark)
    return drop_unidentified(docs, train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in windows of three that were seen before go; every document stays, with what is left of its text."""
    prepare(spark)
    return line_dedup(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their five-word shingles) the document of the smallest doc_id stays; empty texts are one group."""
    prepare(spark)
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a tenth of its characters in edits, go."""
    prepare(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences of 4096 tokens."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [
    ("language identification", language),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packing),
]

# Language identification and packing are no SQL; run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again by the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
