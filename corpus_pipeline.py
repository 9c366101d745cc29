"""A training corpus from raw documents: five stages, each one operator over all that came before.

Quality rules drop what they reject; near-dedup leaves one document of each group;
decontamination drops documents that hold benchmark passages; the secret scan masks
secrets and keeps every document; BPE turns texts into token ids.  Each stage takes
(spark, docs, sf_dir) and returns a table that is written as Parquet and read again as
the next one's ``docs``; all but the last return the columns they were given.

Near-dedup takes five words to a shingle and a similarity of 0.8; decontamination and the
other stages take the values of the registered queries.

Rows are told apart by doc_id and a 64-bit hash of the text, never by doc_id alone: what an
operator says of one row moves no other row that repeats its id or has none either.

Defined cases: null texts, and texts under 50 words, are rejected by the first stage; rows
that repeat a doc_id (or its absence) and the text are one document from near-dedup on; of a
group of near duplicates the row with the smallest doc_id stays, of equal ids the one with the
smallest hash, and of a group without ids one row too; very long texts go through every stage
whole; columns of any further names are carried along as they are; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import bpe_trie, decontamination, near_dedup, quality_rules, secrets
from loamstone.llm.common import mark, materialise, small, table
from loamstone.llm.queries import tokenizer


#: Words of a shingle, and the percentage of common shingles from which documents are near duplicates.
SHINGLE, PERCENT = 5, 80
#: Words that the last stage's workers remember: fewer than alone, as earlier stages fill the executors' heaps.
CACHE_WORDS = 150_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return quality_rules.accepted(judged).select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    found = near_dedup.near_groups(docs, PERCENT, SHINGLE)
    kept = materialise(near_dedup.survivors(found), "kept-rows")
    own = docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (mark(docs["text"]) == kept["kept_mark"])
    rows = docs.join(small(kept), own, "left_semi")
    again = found.groupBy("doc_id", "mark").agg(F.count("*").alias("rows")).filter("rows > 1")
    return rows if again.isEmpty() else rows.dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    found = decontamination.marked_contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    bad = materialise(found.select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct(), "contaminated-rows")
    own = docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (mark(docs["text"]) == bad["bad_mark"])
    return docs.join(small(bad), own, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    scanner = secrets.Scanner.trained(spark, tokenizer("word_bpe_49k.json"))
    found = secrets.find_secrets(docs, scanner, "source" if "source" in docs.columns else None)
    row, clean = found["row"], found["clean"]
    new = {"text": clean}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(clean.eqNullSafe(row["text"]), row["n_chars"]).otherwise(F.length(clean).cast("long"))
    return found.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document."""
    coded = bpe_trie.encode_documents(docs, tokenizer("word_bpe_49k.json"), CACHE_WORDS)
    return coded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: Union-find, a forest and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
