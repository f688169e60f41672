"""Collects the plan modules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundwork.operators import index as N, retrieval as V
from groundwork.plans import corpus_plans, evaluation_plans, governance_plans, retrieval_plans, rule_plans, source_plans, telemetry_plans, text_plans, vector_plans  # noqa: F401
from groundwork.plans.base import ORACLES, QUERIES  # noqa: F401
from groundwork.session import materialize, scratch_dir


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalize, de-duplicate, index and answer every benchmark item in one batch."""
    kept = corpus_plans.accepted(spark, sf_dir).select(F.col("ord").alias("doc_id"), "case_text", "target", "source", "task")
    kept = materialize(kept, "accepted")
    index = N.write_index(kept, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}")
    return V.project_hits(N.bm25_topk(index, retrieval_plans.asked(spark, sf_dir)), kept)
