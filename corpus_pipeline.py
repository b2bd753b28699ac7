"""A training corpus from `documents`: classify, dedup lines, drop near copies, decontaminate, mix sources.

Every stage reads all rows that the stage before it kept, from Parquet in the shared folder; nothing is sampled. The
first four return the columns of documents, the last one row per document with the words that the mix takes of it and their training positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.llm import cotraining, decontamination, line_dedup, mixing, near_dedup
from lumensift.llm.common import read, saved


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go."""
    return cotraining.accepted(docs, cotraining.fit(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three repeated lines go; n_chars follows the text."""
    cleaned = line_dedup.line_dedup(docs).drop("_n_lines_removed")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.without_near_copies(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote a benchmark item go."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document, in training order: source, sizes, its source's target, the words taken of it and the
    training position of each pass."""
    return mixing.ordered(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Classifier, sketches and edit distances have no SQL form; the tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
