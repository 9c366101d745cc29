"""All registered queries of the engine's own operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import content, graphs, ingestion, search

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents match each benchmark text best: BM25 and a deterministic reranker, fused."""
    return search.flagship(spark, sf_dir)


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**search.QUERIES, **graphs.QUERIES, **content.QUERIES, **ingestion.QUERIES}


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
