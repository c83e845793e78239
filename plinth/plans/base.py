"""Registration of queries: a plan, and the same result in plain SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth import schema
from plinth.sources.star import TABLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return keep


def dealt(values: list[tuple], columns: str, key: str = "o_orderkey") -> str:
    """``orders o`` with one of ``values`` (fixed rows, as ``v``) for each row, by its ``key``; every (n + 1)-th row has none."""
    rows = schema.values_sql([(k, *v) for k, v in enumerate(values)], f"k, {columns}")
    return f"{{orders}} o LEFT JOIN {rows} v ON v.k = o.{key} % {len(values) + 1}"


def both(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A fixture in SQL that both engines read alike: tables appear as ``{name}``."""
    names = (*TABLES, "documents", "pages", "benchmark", "labels", "events", "embeddings", "conversations")
    return spark.sql(text.replace("VARCHAR", "STRING"), **{t: table(spark, sf_dir, t) for t in names if "{" + t + "}" in text})


def plain(text: str) -> str:
    for t in (*TABLES, "documents", "pages", "benchmark", "labels", "events", "embeddings", "conversations"):
        text = text.replace("{" + t + "}", t)
    return text
