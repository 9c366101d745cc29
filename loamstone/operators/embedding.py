"""Embedding providers and the index that holds their vectors."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument


class EmbeddingProvider(ABC):
    """Vectors for batches of documents and of queries, which may differ in kind."""

    @abstractmethod
    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return self.embed_documents(texts)


class HashingEmbedder(EmbeddingProvider):
    """The offline default: signed hashed words, unit length, the same on every machine."""

    def __init__(self, size: int = 256) -> None:
        self.size = size

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()) or [""]:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1.0 if h >> 63 else -1.0
            if not row.any():
                row[0] = 1.0
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()


def embed(text: Column, provider: EmbeddingProvider, queries: bool = False) -> Column:
    """A vector column; blank texts, missing vectors and vectors of several sizes are errors."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = None
        for batch in batches:
            texts = batch.fillna("").tolist()
            if any(not t.strip() for t in texts):
                raise ValueError("a blank text cannot be embedded")
            vectors = (provider.embed_queries if queries else provider.embed_documents)(texts)
            sizes = {len(v) for v in vectors} | ({size} if size else set())
            if len(vectors) != len(texts) or len(sizes) > 1 or 0 in sizes:
                raise ValueError("the provider returned too few vectors or vectors of several sizes")
            size = next(iter(sizes), size)
            yield pd.Series(vectors, dtype=object)

    return F.pandas_udf(work, "array<double>")(text)


def embed_chunks(chunks: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    return chunks.withColumn("embedding", embed(F.col("content"), provider))


def embed_queries(queries: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    return queries.withColumn("embedding", embed(F.col("text"), provider, True))


def vector_size(chunks: DataFrame) -> int | None:
    """The one size of all vectors, None without any."""
    row = chunks.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if row["low"] is None:
        return None
    if row["low"] <= 0 or row["low"] != row["high"]:
        raise InvalidArgument("vectors are empty or of several sizes")
    return row["low"]
