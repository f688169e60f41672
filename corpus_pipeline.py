"""A corpus from raw documents in five stages, each with one operator of ``groundwork.llm``.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and
read again. Documents that fail the quality rules go, one document of each component of
near duplicates stays (the one with the smallest id), documents with benchmark passages go,
sources are brought to their target weights in whole documents, and all that is left is
dealt to 24 shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundwork.llm import decontam, mixing, ngram_join, quality, sharding
from groundwork.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and reach the likelihood-ratio threshold."""
    return quality.kept_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row per component of documents that are linked at 0.8 on 5-word shingles."""
    return ngram_join.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of a benchmark item."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out whole documents so that each source comes to its target."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ``shard`` (0 to 23) and its ``slot`` there."""
    return sharding.shard_documents(docs, shards=24)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]

#: The likelihood ratio, the edit search and the packing have no SQL form;
#: tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
