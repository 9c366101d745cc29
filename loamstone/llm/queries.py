"""Registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe_trie, decontamination, licenses, near_dedup, quality_classifier, quality_rules, secrets, sharding, sql,
    suffix_dedup, token_files,
)
from .common import table

#: The id that ends each document in token files.
END_ID = 2


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; vocabularies are never kept in the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = token_files.write_segments(docs, path or tokenizer("byte_bpe_50k.json"), END_ID)
    return token_files.read_segments(spark, written)


def op2_secrets(spark: SparkSession, sf_dir: str, dictionary: str | None = None) -> DataFrame:
    scanner = secrets.Scanner.trained(spark, dictionary or tokenizer("word_bpe_49k.json"))
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), scanner)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_bpe_trie(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe_trie.digest_documents(table(spark, sf_dir, "documents"), path or tokenizer("word_bpe_49k.json"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    return {
        "op1_token_files": op1_token_files,
        "op2_secrets": op2_secrets,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_decontamination": op5_decontamination,
        "op6_near_dedup": op6_near_dedup,
        "op7_sharding": op7_sharding,
        "op8_bpe_trie": op8_bpe_trie,
        "op9_licenses": op9_licenses,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op5_decontamination": sql.DECONTAMINATION, "op6_near_dedup": sql.NEAR_DUPLICATES,
        "op7_sharding": sql.sharding(sharding.SHARD_BYTES),
    }
