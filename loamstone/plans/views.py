"""The driver's tables seen as the engine's rows: chunks, queries, elements, edges, boxes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.postings import PostingIndex
from ..scratch import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk, named by its id so that ties go by number in text order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.lit(0).alias("chunk_index"),
        F.coalesce("text", F.lit("")).alias("content"),
    )


def document_index(spark: SparkSession, sf_dir: str) -> PostingIndex:
    """The stored index of :func:`document_chunks`: made once in this application for a state of the table's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    state = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    index = PostingIndex(spark, fixed(spark, f"index-{hashlib.sha256(repr(state).encode()).hexdigest()[:24]}"))
    if not index.exists():
        index.backfill(document_chunks(spark, sf_dir))
    return index


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"),
        F.lit("").alias("content"), "embedding", "label", "vec_id",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding", "label", "vec_id")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as elements of their sources, in doc_id order."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("element_id"), F.col("doc_id").cast("int").alias("ordinal"),
        F.when(F.col("doc_id") % 7 == 0, "heading").otherwise("paragraph").alias("element_type"),
        F.when(F.col("doc_id") % 11 == 0, "table").when(F.col("doc_id") % 13 == 0, "image").otherwise("text").alias("content_kind"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("doc_id") % 26 == 0, "").when(F.col("doc_id") % 13 == 0, F.concat(F.lit("img/"), F.col("doc_id").cast("string"))).alias("asset_path"),
        F.to_json(F.struct("lang")).alias("metadata"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived edges: n refers to n / 2, sources differ mostly; every fifth is weak; some ends do not exist."""
    docs = table(spark, sf_dir, "documents")
    target = F.when(F.col("doc_id") % 17 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.floor(F.col("doc_id") / 2))
    return docs.select(
        F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("rel_ordinal"), F.col("doc_id").cast("string").alias("source_element_id"),
        F.when(F.col("doc_id") % 5 == 0, "follows").when(F.col("doc_id") % 3 == 0, "contains").otherwise("refers_to").alias("relationship_type"),
        target.cast("string").alias("target_element_id"),
    )


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside sources: each document to the one four places before in its source, three of four strong."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    before = F.lag("doc_id", 4).over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.withColumns({"n": at, "before": before}).filter("before is not null").select(
        F.col("source").alias("document_id"), F.col("n").alias("rel_ordinal"), F.col("doc_id").cast("string").alias("source_element_id"),
        F.when(F.col("n") % 4 == 0, "follows").when(F.col("n") % 3 == 0, "contains").otherwise("refers_to").alias("relationship_type"),
        F.col("before").cast("string").alias("target_element_id"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes: 50 to a page, placed by their keys."""
    k = F.col("p_partkey")
    x, y = (k * 137) % 600, (k * 71) % 800
    return table(spark, sf_dir, "part").select(
        F.lit("parts").alias("document_id"), k.cast("string").alias("element_id"), k.cast("int").alias("ordinal"),
        F.floor(k / 50).cast("int").alias("page_number"), F.lit(None).cast("int").alias("slide_number"),
        G.bbox(x, y, x + 40 + k % 60, y + 10 + k % 30).alias("bbox"), "p_name",
    )


def boxes_sql() -> str:
    """:func:`boxes` for DuckDB."""
    return """select p_partkey as k, cast(floor(p_partkey / 50) as int) as page,
        cast((p_partkey * 137) % 600 as double) as x0, cast((p_partkey * 71) % 800 as double) as y0,
        cast((p_partkey * 137) % 600 + 40 + p_partkey % 60 as double) as x1, cast((p_partkey * 71) % 800 + 10 + p_partkey % 30 as double) as y1,
        p_name from part"""


def layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(objects, texts): every third box is an image or a table, the others are texts that name figures and tables."""
    base = boxes(spark, sf_dir)
    k = F.col("ordinal")
    objects = base.filter(k % 3 == 0).withColumn("kind", F.when(k % 2 == 0, "image").otherwise("table"))
    said = F.concat(F.when(k % 4 < 2, "see Figure ").when(k % 4 == 2, "Table ").otherwise("plain "), (k % 9).cast("string"), F.lit(". "), F.col("p_name"))
    return objects, base.filter(k % 3 != 0).withColumn("text", said)


def layout_sql() -> str:
    """CTEs ``boxes``, ``objects`` and ``texts`` for DuckDB."""
    return f"""boxes as ({boxes_sql()}),
        objects as (select *, case when k % 2 = 0 then 'image' else 'table' end as kind from boxes where k % 3 = 0),
        texts as (select *, (case when k % 4 < 2 then 'see Figure ' when k % 4 = 2 then 'Table ' else 'plain ' end) || (k % 9) || '. ' || p_name as text
            from boxes where k % 3 <> 0)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and the like as segments of two to nine seconds in their user's time."""
    events = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    return events.filter("event_id % 4 = 0").select(
        F.col("user_id").cast("string").alias("document_id"), F.col("event_id").cast("string").alias("element_id"),
        F.col("t").alias("start_seconds"), (F.col("t") + 2 + F.col("event_id") % 8 * 600).alias("end_seconds"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    return events.filter("event_id % 4 <> 0").select(
        F.col("user_id").cast("string").alias("document_id"), F.col("event_id").cast("string").alias("element_id"), F.col("t").alias("timestamp_seconds")
    )

