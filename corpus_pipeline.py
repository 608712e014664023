"""From raw documents to packed sequences: five stages, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import dartminhash, linededup, packing, quality, schedule
from rollbook.llm.queries import TOKENIZER
from rollbook.llm.shared import table
from rollbook.sources.staging import stage


def quality_stage(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, root, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return dartminhash.one_of_each(docs, stored=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus."""
    return linededup.cleaned(docs, stored=True)


def mixture(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """What the mix takes of each document, one row for each round."""
    return schedule.mixed(docs, stored=True)


def sequences(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packing.pack(docs, TOKENIZER, stored=True)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: No SQL expresses the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, root: str) -> DataFrame:
    """All stages over the documents of ``root``; results between them are written."""
    docs = table(spark, root, "documents")
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, root)
        if number < len(STAGES) - 1:
            docs = stage(docs, f"stage_{number}")
    return docs
