"""Images, audio, video and PDF through plug-ins.

Models and external programs are not part of the engine: a plug-in is a pandas UDF (or
any column expression) from a path to what :class:`Plugins` names.  Without one, images,
audio and video yield their root and asset element only, and a PDF is refused.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.relationships import captions, drop_inside_tables, link_texts, references, spatial_edges, temporal_edges
from ..scratch import materialise
from .captions import key_frames, parse_captions, sidecars

SEGMENTS = "array<struct<start_seconds:double,end_seconds:double,text:string>>"
BLOCKS = "array<struct<page_number:int,kind:string,text:string,asset_path:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"


FRAMES = "array<struct<timestamp_seconds:double,asset_path:string,difference:double>>"
ELEMENT_ORDER = ["document_id", "element_id", "ordinal", "element_type", "content_kind", "text", "asset_path", "metadata"]
EDGE_ORDER = ["document_id", "rel_ordinal", "source_element_id", "relationship_type", "target_element_id", "metadata"]
#: Places of a document's derived edges start here, behind those that a parser numbers.
DERIVED = 1_000_000


@dataclass(frozen=True)
class Plugins:
    """What reads that which needs a model or a program; each maps a path column to a column."""

    layout: Callable[[Column], Column] | None = None  # PDF to BLOCKS
    recognise: Callable[[Column], Column] | None = None  # audio to SEGMENTS
    embedded_captions: Callable[[Column], Column] | None = None  # video to SRT or WebVTT text, null without any
    audio_track: Callable[[Column], Column] | None = None  # video to the path of its sound
    frames: Callable[[Column], Column] | None = None  # video to FRAMES, sampled
    vision: Callable[[Column], Column] | None = None  # image to text


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def _edges(rows: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
    """Edges in order of ``place``, numbered behind a parser's own."""
    return rows.select(
        "document_id", (F.lit(DERIVED) + F.col("place")).cast("int").alias("rel_ordinal"), source.alias("source_element_id"),
        F.lit(kind).alias("relationship_type"), target.alias("target_element_id"), F.lit("{}").alias("metadata"),
    )


def _cues(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else [{"start_seconds": a, "end_seconds": b, "text": s} for a, b, s in parse_captions(t)])


def cues(text: Column) -> Column:
    """SEGMENTS of caption texts; null for a null text."""
    return F.pandas_udf(_cues, SEGMENTS)(text)


def adjacent(elements: DataFrame) -> DataFrame:
    """Edges in space between elements whose metadata has a box, in any of its encodings, by page and slide."""
    number = lambda key: F.get_json_object("metadata", f"$.{key}").cast("int").alias(key)
    boxed = elements.filter(F.col("metadata").contains('"bbox"')).select(
        "document_id", "element_id", "ordinal", number("page_number"), number("slide_number"), G.from_json(F.get_json_object("metadata", "$.bbox")).alias("bbox")
    )
    found = spatial_edges(boxed.filter("bbox is not null"))
    return found.select("document_id", F.lit(2 * DERIVED).alias("rel_ordinal"), "source_element_id", "relationship_type", "target_element_id", F.to_json(F.struct("distance")).alias("metadata"))


def asset_elements(files: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Root and asset element of every file, and the edge between them."""
    own = assets(files, kind).withColumn("metadata", F.lit("{}"))
    held = own.filter("ordinal = 1").withColumn("place", F.lit(0))
    return own.select(*ELEMENT_ORDER), _edges(held, "contains", F.lit("document"), F.col("element_id"))


def spoken(files: DataFrame, segments: Column, owner: str) -> tuple[DataFrame, DataFrame]:
    """Transcript elements of a column of SEGMENTS, and the asset's ``contains`` edges to them."""
    said = files.select("document_id", F.posexplode(segments.cast(SEGMENTS)).alias("i", "s")).filter(F.trim("s.text") != "")
    said = said.withColumns({"place": F.col("i") + 1, "element_id": F.concat(F.lit("transcript-"), (F.col("i") + 1).cast("string"))})
    elements = said.select(
        "document_id", "element_id", (F.lit(1) + F.col("place")).cast("int").alias("ordinal"), F.lit("transcript").alias("element_type"),
        F.lit("text").alias("content_kind"), F.trim("s.text").alias("text"), F.lit(None).cast("string").alias("asset_path"),
        _json(start_seconds=F.col("s.start_seconds"), end_seconds=F.col("s.end_seconds"), segment_index=F.col("place")).alias("metadata"),
    )
    return elements, _edges(said, "contains", F.lit(owner), F.col("element_id"))


def audio(files: DataFrame, plugins: Plugins) -> tuple[DataFrame, DataFrame]:
    """Asset and transcript elements of sound files."""
    elements, edges = asset_elements(files, "audio")
    if plugins.recognise is None:
        return elements, edges
    said, held = spoken(files, plugins.recognise(F.col("path")), "audio-1")
    return elements.unionByName(said), edges.unionByName(held)


def video(files: DataFrame, every: DataFrame, plugins: Plugins) -> tuple[DataFrame, DataFrame]:
    """Asset, transcript and frame elements of videos, with edges in time.

    Captions come first: a caption file of the same stem among ``every(path, content)``, then
    captions inside the video; only a video without either is listened to.
    """
    elements, edges = asset_elements(files, "video")
    beside = sidecars(files.select("document_id", "path"), every.select("path"))
    texts = every.select(F.col("path").alias("caption_path"), F.decode("content", "UTF-8").alias("caption_text"))
    known = beside.join(texts, "caption_path", "left").select("document_id", "path", "caption_text")
    if plugins.embedded_captions is not None:
        known = known.withColumn("caption_text", F.coalesce("caption_text", plugins.embedded_captions(F.col("path"))))
    said, held = spoken(known.filter("caption_text is not null"), cues(F.col("caption_text")), "video-1")
    if plugins.recognise is not None:
        mute = known.filter("caption_text is null")
        track = plugins.audio_track(F.col("path")) if plugins.audio_track is not None else F.col("path")
        more, more_held = spoken(mute, plugins.recognise(track), "video-1")
        said, held = said.unionByName(more), held.unionByName(more_held)
    elements, edges = elements.unionByName(said), edges.unionByName(held)
    if plugins.frames is None:
        return elements, edges
    sampled = files.select("document_id", F.explode(plugins.frames(F.col("path")).cast(FRAMES)).alias("f")).select("document_id", "f.*")
    kept = key_frames(sampled).join(sampled.select("document_id", "timestamp_seconds", "asset_path"), ["document_id", "timestamp_seconds"])
    kept = kept.withColumn("place", F.lit(DERIVED) + F.substring_index("element_id", "-", -1).cast("int"))
    shown = kept.select(
        "document_id", "element_id", F.col("place").cast("int").alias("ordinal"), F.lit("video_frame").alias("element_type"), F.lit("image").alias("content_kind"),
        F.lit(None).cast("string").alias("text"), "asset_path", _json(timestamp_seconds=F.col("timestamp_seconds")).alias("metadata"),
    )
    seconds = lambda key: F.get_json_object("metadata", f"$.{key}").cast("double").alias(key)
    near = temporal_edges(said.select("document_id", "element_id", seconds("start_seconds"), seconds("end_seconds")), kept.select("document_id", "element_id", "timestamp_seconds"))
    near = near.select("document_id", F.lit(2 * DERIVED).alias("rel_ordinal"), "source_element_id", "relationship_type", "target_element_id", F.lit("{}").alias("metadata"))
    return elements.unionByName(shown), edges.unionByName(_edges(kept, "contains", F.lit("video-1"), F.col("element_id"))).unionByName(near)


def paged(files: DataFrame, layout: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Pages and blocks of PDF files, with edges by place on the page, captions and references.

    Texts that lie inside a table of their page are left out; a link without a text of its
    own takes the words under its box.
    """
    blocks = materialise(pages(files, layout).withColumn("slide_number", F.lit(None).cast("int")), "blocks")
    tabular = blocks.filter("kind = 'table'")
    texts = drop_inside_tables(blocks.filter("kind = 'text'"), tabular)
    links = blocks.filter("kind = 'link'")
    under = link_texts(links, blocks.filter("kind = 'text'")).withColumnRenamed("text", "under")
    links = links.join(under, ["document_id", "element_id"], "left").withColumn("text", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "under")).drop("under")
    kept = materialise(texts.unionByName(tabular).unionByName(blocks.filter("kind = 'image'")).unionByName(links), "kept-blocks")
    kind = F.col("kind")
    page = F.concat(F.lit("page-"), F.col("page_number").cast("string"))
    own = kept.select(
        "document_id", "element_id", (F.col("ordinal") + 100_000).alias("ordinal"), F.when(kind == "text", "paragraph").otherwise(kind).alias("element_type"),
        F.when(kind == "link", "text").otherwise(kind).alias("content_kind"), "text", "asset_path", _json(page_number=F.col("page_number"), bbox=F.col("bbox")).alias("metadata"),
    )
    leaves = kept.select("document_id", "page_number").distinct()
    root = files.select("document_id").distinct().select("document_id", F.lit("document").alias("element_id"), F.lit(0).alias("ordinal"), F.lit("document").alias("element_type"))
    sheets = root.unionByName(leaves.select("document_id", page.alias("element_id"), F.col("page_number").alias("ordinal"), F.lit("page").alias("element_type")))
    sheets = sheets.select("document_id", "element_id", "ordinal", "element_type", F.lit("text").alias("content_kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("asset_path"), F.lit("{}").alias("metadata"))
    boxes = kept.filter("bbox is not null")
    objects, said = boxes.filter("kind in ('image', 'table')"), boxes.filter("kind = 'text'")
    named = captions(objects, said)
    derived = [spatial_edges(boxes.filter("kind <> 'link'")), named, references(said, named)]
    edges = _edges(leaves.withColumn("place", F.col("page_number")), "contains", F.lit("document"), page)
    edges = edges.unionByName(_edges(kept.withColumn("place", 100_000 + F.col("ordinal")), "contains", page, F.col("element_id")))
    for n, found in enumerate(derived, start=2):
        edges = edges.unionByName(found.select("document_id", F.lit(n * DERIVED).alias("rel_ordinal"), "source_element_id", "relationship_type", "target_element_id", F.lit("{}").alias("metadata")))
    return sheets.unionByName(own.select(*ELEMENT_ORDER)), edges.select(*EDGE_ORDER)


def assets(files: DataFrame, kind: str) -> DataFrame:
    """Root and asset elements of ``files(document_id, path)``: a projection, no bytes are read."""
    root = F.struct(F.lit("document").alias("element_id"), F.lit("document").alias("element_type"), F.lit("text").alias("content_kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("asset_path"))
    own = F.struct(F.lit(f"{kind}-1").alias("element_id"), F.lit(kind).alias("element_type"), F.lit(kind).alias("content_kind"), F.lit(None).cast("string").alias("text"), F.col("path").alias("asset_path"))
    return files.select("document_id", F.posexplode(F.array(root, own)).alias("ordinal", "e")).select("document_id", "ordinal", "e.*")


def transcripts(files: DataFrame, recognise: Callable[[Column], Column]) -> DataFrame:
    """Transcript elements from a recogniser (path to SEGMENTS); blank segments are dropped."""
    said = files.select("document_id", F.posexplode(recognise(F.col("path")).cast(SEGMENTS)).alias("i", "s")).filter(F.trim("s.text") != "")
    return said.select("document_id", F.concat(F.lit("transcript-"), (F.col("i") + 1).cast("string")).alias("element_id"), F.trim("s.text").alias("text"), "s.start_seconds", "s.end_seconds")


def pages(files: DataFrame, layout: Callable[[Column], Column]) -> DataFrame:
    """Blocks of paged files from a layout reader (path to BLOCKS), numbered inside each page."""
    cut = files.select("document_id", F.posexplode(layout(F.col("path")).cast(BLOCKS)).alias("ordinal", "b")).select("document_id", "ordinal", "b.*")
    return cut.withColumn("element_id", F.concat_ws("-", F.lit("page"), F.col("page_number").cast("string"), F.col("kind"), F.col("ordinal").cast("string")))


def describe(elements: DataFrame, vision: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(semantic elements, ``derived_from`` edges) for image elements from a vision plug-in (path to text).

    A blank description is an error, as is an image without a path.
    """
    images = elements.filter("element_type = 'image'").withColumn("said", F.trim(vision(F.col("asset_path"))))
    sure = F.assert_true(F.coalesce(F.col("said") != "", F.lit(False)), F.lit("an image has no description"))
    checked = images.filter(sure.isNull())
    own = F.concat("element_id", F.lit(":semantic"))
    made = checked.select("document_id", own.alias("element_id"), "ordinal", F.lit("image_semantic").alias("element_type"), F.lit("text").alias("content_kind"), F.col("said").alias("text"))
    edges = checked.select("document_id", own.alias("source_element_id"), F.lit("derived_from").alias("relationship_type"), F.col("element_id").alias("target_element_id"))
    return made, edges


def enriched(elements: DataFrame, relationships: DataFrame, vision: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``elements`` and ``relationships`` with what a vision plug-in says of images, each text beside its image."""
    made, edges = describe(elements, vision)
    made = made.withColumns({"asset_path": F.lit(None).cast("string"), "metadata": F.lit("{}")}).select(*ELEMENT_ORDER)
    edges = edges.select("document_id", F.lit(9 * DERIVED).alias("rel_ordinal"), "source_element_id", "relationship_type", "target_element_id", F.lit("{}").alias("metadata"))
    return elements.unionByName(made), relationships.unionByName(edges)


def write_assets(assets_found: DataFrame, folder: str) -> DataFrame:
    """Writes ``(document_id, asset_path, bytes)`` as rows under ``folder``, one folder for each hash bucket of the
    document, and returns (document_id, asset_path, size)."""
    rows = assets_found.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(64)).cast("int"))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)
    stored = assets_found.sparkSession.read.parquet(folder)
    return stored.select("document_id", "asset_path", F.octet_length("bytes").alias("size"))

# Labels of the parts of a description.
READABLE, VISIBLE, CONTEXT = "Readable text: ", "Visual elements: ", "Context: "


def description(visual: Column) -> Column:
    """The text of a structured description (description, ocr_text, visual_elements, document_context)."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    items = F.nullif(F.array_join(visual["visual_elements"], ", "), F.lit(""))
    return F.concat_ws(
        "\n", filled(visual["description"]), F.concat(F.lit(READABLE), filled(visual["ocr_text"])),
        F.concat(F.lit(VISIBLE), items), F.concat(F.lit(CONTEXT), filled(visual["document_context"])),
    )


def _images(packages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in packages:
        out = []
        for data in batch:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                out.append([{"asset_path": n, "bytes": z.read(n)} for n in sorted(z.namelist()) if "/media/" in n])
        yield pd.Series(out)


def asset_table(files: DataFrame) -> DataFrame:
    """(document_id, asset_path, bytes) of the images inside Office ``files(document_id, content)``."""
    found = F.pandas_udf(_images, "array<struct<asset_path:string,bytes:binary>>")(F.col("content"))
    return files.select("document_id", F.explode(found).alias("a")).select("document_id", "a.*")
