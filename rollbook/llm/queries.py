"""The operators of this package as named queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import (
    crosspolytope,
    dartminhash,
    linededup,
    linkgraph,
    outliers,
    packing,
    personal,
    quality,
    revisits,
    schedule,
    turns,
    whitening,
    wrapper,
)
from rollbook.llm.oracle import ORACLE  # noqa: F401
from rollbook.llm.shared import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def wrapper_text(spark: SparkSession, root: str) -> DataFrame:
    return wrapper.extract(table(spark, root, "pages"), stored=True)


def robust_outliers(spark: SparkSession, root: str) -> DataFrame:
    return outliers.judged(table(spark, root, "documents")).drop("distance")


def quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    return quality.judged(table(spark, root, "documents"), table(spark, root, "labels"))


def cross_polytope(spark: SparkSession, root: str) -> DataFrame:
    return crosspolytope.search(table(spark, root, "embeddings"))


def revisit_resolution(spark: SparkSession, root: str) -> DataFrame:
    """The headers as text, name=value by name, and the body by its digest."""
    captures = revisits.captures_of(table(spark, root, "pages"), stored=True)
    found = revisits.resolve(captures, placed=True)
    named = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return found.select(
        "capture_id",
        "url_key",
        "at",
        "response_id",
        "status",
        F.md5("body").alias("body_md5"),
        F.array_join(named, ";").alias("headers"),
    )


def dart_minhash(spark: SparkSession, root: str) -> DataFrame:
    return dartminhash.classes(table(spark, root, "documents"), stored=True)


def link_graph(spark: SparkSession, root: str) -> DataFrame:
    return linkgraph.verdicts(table(spark, root, "pages"))


def histogram_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), TOKENIZER, stored=True)


def line_dedup(spark: SparkSession, root: str) -> DataFrame:
    return linededup.removals(table(spark, root, "documents"), stored=True)


def source_schedule(spark: SparkSession, root: str) -> DataFrame:
    return schedule.taken(table(spark, root, "documents"), stored=True)


def turn_alignment(spark: SparkSession, root: str) -> DataFrame:
    return turns.audited(table(spark, root, "conversations"), stored=True)


def jacobi_whitening(spark: SparkSession, root: str) -> DataFrame:
    found = whitening.whitened(table(spark, root, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def semi_markov_pii(spark: SparkSession, root: str) -> DataFrame:
    return personal.reported(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_text": wrapper_text,
    "op2_robust_outliers": robust_outliers,
    "op3_quality_classifier": quality_classifier,
    "op4_cross_polytope": cross_polytope,
    "op5_revisit_resolution": revisit_resolution,
    "op6_dart_minhash": dart_minhash,
    "op7_link_graph": link_graph,
    "op8_histogram_packing": histogram_packing,
    "op9_line_dedup": line_dedup,
    "op10_source_schedule": source_schedule,
    "op11_turn_alignment": turn_alignment,
    "op12_jacobi_whitening": jacobi_whitening,
    "op13_semi_markov_pii": semi_markov_pii,
}
