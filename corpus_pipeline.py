"""The corpus pipeline: language ID, toxicity, exact dedup, near dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each stage's
rows as Parquet in the folder that the cluster shares and reads them again.  A stage's own tables, and the rows of the
stage before, are removed once its rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm import exact, langid, neardup, packing, toxicity
from wayfarer.llm.common import remove, scratch, shared_dir, table, written
from wayfarer.llm.queries import VOCABULARY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no language: null texts, texts without a letter, and texts of which no language gets a
    share above chance.  A null lang becomes the predicted one."""
    return langid.language_filter(docs, langid.learn(langid.training_rows(docs)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that score as toxic."""
    return toxicity.toxicity_filter(docs, toxicity.learn(*toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row stays whose id the digest index holds: the smallest."""
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays."""
    return neardup.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows of 2048 ids."""
    return packing.pack(docs, VOCABULARY, 2048, 1)


STAGES = [("language", language), ("toxicity", clean), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Tokenization and the learned stages have no SQL; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, folder)
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
