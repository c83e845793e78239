"""Registry of the engine's own queries: name -> plan, name -> the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.plans import analytic_queries, graph_queries, text_queries  # noqa: F401  each module registers its queries
from plinth.plans.base import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.flagship_evidence_pack(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
