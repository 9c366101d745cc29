"""Incremental ingestion: new files become elements, edges and chunks, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents
from ..operators.preprocess import preprocess
from ..operators.store import Store
from ..scratch import materialise
from ..sources.media import Plugins
from ..sources.registry import load_all, source_type

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(store: Store, files: DataFrame, size: int = 1000, overlap: int = 100, plugins: Plugins | None = None) -> dict[str, int]:
    """One batch of ``files(document_id, path, content)`` through the whole chain; replaces by document.

    Elements, edges, chunks and documents become visible by one commit.  A file that cannot be
    read is stored as a failed document with its error and no elements; the others go on.  Any
    other failure marks the run failed and is raised again; nothing of the batch is visible then.
    """
    run = store.start_run()
    try:
        loaded = load_all(files, plugins)
        failed = materialise(loaded.failures.groupBy("document_id").agg(F.min("error").alias("error")), "failures")
        elements, edges = preprocess(loaded.elements, loaded.relationships)
        edges = materialise(edges, "edges")
        chunks = materialise(chunk_documents(elements, edges, size, overlap), "chunks")
        state = F.when(F.col("error").isNull(), F.create_map(F.lit("processing_status"), F.lit("completed"), F.lit("error"), F.lit(None).cast("string"))).otherwise(
            F.create_map(F.lit("processing_status"), F.lit("failed"), F.lit("error"), F.col("error"))
        )
        documents = files.join(failed, "document_id", "left").select(
            "document_id", F.coalesce(source_type(F.col("path")), F.lit("unknown")).alias("source_type"), "path", state.alias("metadata")
        )
        store.persist(documents, elements, edges, allow_existing=True, chunks=chunks)
        counts = {"elements": elements.count(), "relationships": edges.count(), "chunks": chunks.count(), "failed": failed.count()}
    except Exception as e:
        store.fail_run(run, str(e)[:500])
        raise
    store.finish_run(run, None, str(counts))
    return counts


def stream_folder(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Everything new in a folder, then stop; a batch that is run again replaces its own documents."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    files = source.select(F.sha2("path", 256).alias("document_id"), "path", "content")

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            ingest(store, rows.filter(source_type(F.col("path")).isNotNull()))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: str, time: str, within: str = "1 hour") -> DataFrame:
    """An extension: rows whose key was seen within the watermark are left out in-stream."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
