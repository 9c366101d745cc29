"""Which loader reads what, and reading whole folders."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedSource
from ..functions.paths import extension
from ..scratch import materialise
from . import captions, html, media, office, plain
from .loaded import failures, parse, tables

# Extensions of each source type.
EXTENSIONS = {
    "pdf": (".pdf",),
    "docx": (".docx",),
    "pptx": (".pptx",),
    "excel": (".xlsx", ".xlsm"),
    "csv": (".csv",),
    "markdown": (".md", ".markdown"),
    "html": (".html", ".htm"),
    "txt": (".txt",),
    "captions": (".srt", ".vtt"),
    "image": (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif"),
    "audio": (".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg"),
    "video": (".mp4", ".mov", ".mkv", ".avi", ".webm"),
}

#: Parser and the columns it takes, of the types that need no plug-in.
PARSERS = {
    "csv": (plain.read_csv, ("text",)),
    "txt": (plain.read_txt, ("text",)),
    "markdown": (plain.read_markdown, ("text", "path")),
    "html": (html.read_html, ("text",)),
    "captions": (captions.read_captions, ("text",)),
    "docx": (office.read_docx, ("content",)),
    "pptx": (office.read_pptx, ("content",)),
    "excel": (office.read_xlsx, ("content",)),
}


def source_type(path: Column) -> Column:
    """The source type of a path by its suffix, null for an unsupported one."""
    suffix = extension(path)
    return F.coalesce(*[F.when(suffix.isin(*known), F.lit(kind)) for kind, known in EXTENSIONS.items()])


def require_supported(files: DataFrame) -> DataFrame:
    """The files, if all have a loader."""
    bad = files.filter(source_type(F.col("path")).isNull()).select("path").first()
    if bad is not None:
        raise UnsupportedSource(bad["path"])
    return files


@dataclass(frozen=True)
class Loaded:
    """What a set of files gives: two tables, and why some files gave nothing."""

    elements: DataFrame
    relationships: DataFrame
    failures: DataFrame


def load_all(files: DataFrame, plugins: media.Plugins | None = None, parsers: dict | None = None) -> Loaded:
    """``files(document_id, path, content)``, each type through its parser or plug-in; ``parsers`` adds to those known.

    A file that cannot be read, or whose type needs a plug-in that is not there, is a row
    (document_id, error) of ``failures`` and harms no other file.
    """
    plugins = plugins or media.Plugins()
    typed = files.withColumn("source_type", source_type(F.col("path")))
    parsed = []
    for kind, (parser, columns) in {**PARSERS, **(parsers or {})}.items():
        own = typed.filter(F.col("source_type") == kind)
        if "text" in columns:
            own = own.withColumn("text", F.decode("content", "UTF-8"))
        parsed.append(parse(own, parser, *columns))
    read = materialise(reduce(DataFrame.unionByName, parsed), "parsed")
    elements, edges = tables(read)
    edges = edges.unionByName(media.adjacent(elements))
    refused = [failures(read), typed.filter("source_type is null").select("document_id", F.lit("unsupported source").alias("error"))]
    own = lambda kind: typed.filter(F.col("source_type") == kind)
    parts = [media.asset_elements(own("image"), "image"), media.audio(own("audio"), plugins), media.video(own("video"), files, plugins)]
    if plugins.layout is not None:
        parts.append(media.paged(own("pdf"), plugins.layout))
    else:
        refused.append(own("pdf").select("document_id", F.lit("PDF needs a layout plug-in").alias("error")))
    for more, links in parts:
        elements, edges = elements.unionByName(more), edges.unionByName(links)
    if plugins.vision is not None:
        elements, edges = media.enriched(elements, edges, plugins.vision)
    found = reduce(DataFrame.unionByName, refused)
    empty = files.select("document_id").join(elements.select("document_id").distinct(), "document_id", "left_anti").join(found, "document_id", "left_anti")
    return Loaded(elements, edges, found.unionByName(empty.select("document_id", F.lit("nothing was read").alias("error"))))


def load(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, relationships) of files that need no plug-in."""
    found = load_all(files)
    return found.elements, found.relationships


def read_folder(spark: SparkSession, path: str, limit: int = 50 << 20) -> DataFrame:
    """(document_id, path, content) of files up to ``limit`` bytes; the id is a digest of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= limit)
    return files.select(F.sha2("path", 256).alias("document_id"), "path", "content")


def read_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, relationships) of crawled ``pages(document_id, url, html)``, links resolved against the url."""
    return tables(parse(pages, html.read_html, "html", "url"))
