"""A session with the settings the engine expects, and typed engine settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine; every one is a parameter of the operator it concerns too."""

    collection: str = "knowledge_chunks"
    top_k: int = 5
    candidate_k: int = 10
    rrf_k: int = 60
    chunk_size: int = 1000
    chunk_overlap: int = 100
    max_hops: int = 1
    upload_limit: int = 50 << 20


def build_session(name: str = "loamstone", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting, Arrow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
