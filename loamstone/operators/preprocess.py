"""Preprocessing of elements and edges: normalise, validate, deduplicate, reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..scratch import materialise


def invalid_reason() -> Column:
    """Why an element's content is invalid, null if it is fine."""
    blank_text = F.coalesce(T.strip(F.col("text")), F.lit("")) == ""
    blank_path = F.coalesce(T.strip(F.col("asset_path")), F.lit("")) == ""
    kind = F.col("content_kind")
    return (
        F.when((kind == "text") & blank_text, "empty_text")
        .when((kind == "table") & blank_text, "empty_table")
        .when((kind == "image") & blank_path, "missing_image_path")
        .when((kind == "audio") & blank_path, "missing_audio_path")
        .when((kind == "video") & blank_path, "missing_video_path")
        .when(kind.isNull() | ~kind.isin("text", "table", "image", "audio", "video"), "unsupported_content_type")
    )


def normalize_elements(elements: DataFrame) -> DataFrame:
    """Texts of text and table elements, and the known keys of every element's metadata, made uniform."""
    textual = F.col("content_kind").isin("text", "table")
    clean = elements.withColumn("text", F.when(textual, T.normalize_text("text")).otherwise(F.col("text")))
    return clean.withColumn("metadata", M.normalize_json(F.col("metadata"))) if "metadata" in elements.columns else clean


def normalize_edges(relationships: DataFrame) -> DataFrame:
    if "metadata" not in relationships.columns:
        return relationships
    return relationships.withColumn("metadata", M.normalize_json(F.col("metadata")))


def valid_elements(elements: DataFrame) -> DataFrame:
    return elements.filter(invalid_reason().isNull())


def deduplicate(elements: DataFrame) -> DataFrame:
    """Of equal stripped texts in a document the first in order stays; other contents all stay.

    Keys are hashes, so the window moves no texts for comparison, and only text elements go
    through it.
    """
    textual = elements.filter("content_kind = 'text'").withColumn("content_key", T.content_hash(T.strip(F.col("text"))))
    first = Window.partitionBy("document_id", "content_key").orderBy("ordinal", "element_id")
    kept = textual.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place", "content_key")
    return kept.unionByName(elements.filter("content_kind is null or content_kind <> 'text'"))


def reconcile(relationships: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges whose both ends are among the elements."""
    ids = elements.select("document_id", F.col("element_id").alias("end"))
    out = relationships
    for side in ("source_element_id", "target_element_id"):
        out = out.join(ids.withColumnRenamed("end", side), ["document_id", side], "left_semi")
    return out.select(*relationships.columns)


def preprocess(elements: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole chain; running it twice changes nothing more.

    Normalised elements are written once, and so are those that stay, as the steps behind
    each read them several times.
    """
    valid = materialise(valid_elements(normalize_elements(elements)), "valid")
    clean = materialise(deduplicate(valid), "clean")
    return clean, reconcile(normalize_edges(relationships), clean)


def attach_orphans(elements: DataFrame, relationships: DataFrame, root: str = "document") -> DataFrame:
    """``contains`` edges from each document's root to elements that no edge points to."""
    targets = relationships.select("document_id", F.col("target_element_id").alias("element_id"))
    orphans = elements.filter(F.col("element_id") != root).join(targets, ["document_id", "element_id"], "left_anti")
    return orphans.select(
        "document_id", F.lit(root).alias("source_element_id"), F.lit("contains").alias("relationship_type"),
        F.col("element_id").alias("target_element_id"),
    )
