"""Edges from time and space: interval joins, theta joins inside pages, captions, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

TOLERANCE = 1.0
SPATIAL_GAP = 80.0
CAPTION_GAP = (60.0, 80.0)


def temporal_edges(segments: DataFrame, frames: DataFrame, tolerance: float = TOLERANCE, keys: tuple[str, ...] = ("document_id",), block: float = 10.0) -> DataFrame:
    """Both directions between a segment and each frame inside it, give or take the tolerance.

    The document is the equi key; inside it, time is cut into blocks as long as a typical
    segment, so a frame only meets the segments of its own block, however long a document is.
    """
    cut = segments.withColumn(
        "block",
        F.explode(F.sequence(F.floor((F.col("start_seconds") - tolerance) / block), F.floor((F.col("end_seconds") + tolerance) / block))),
    ).withColumnRenamed("element_id", "segment_id")
    at = frames.withColumn("block", F.floor(F.col("timestamp_seconds") / block)).withColumnRenamed("element_id", "frame_id")
    met = cut.join(at, [*keys, "block"]).filter(
        F.col("timestamp_seconds").between(F.col("start_seconds") - tolerance, F.col("end_seconds") + tolerance)
    )
    ends = lambda a, b: F.struct(F.col(a).alias("source_element_id"), F.col(b).alias("target_element_id"))
    both = F.explode(F.array(ends("segment_id", "frame_id"), ends("frame_id", "segment_id")))
    return met.select(*keys, both.alias("e")).select(*keys, "e.*", F.lit("temporally_adjacent").alias("relationship_type"))


def spatial_edges(boxes: DataFrame, vertical: float = SPATIAL_GAP, horizontal: float = SPATIAL_GAP) -> DataFrame:
    """Both directions between boxes of one document that are near each other on one page and slide.

    Boxes are dealt to grid cells larger than the gaps and than most boxes, whatever their unit,
    so that a box meets its neighbours only; an unknown page or slide goes with any.  Page and slide are part of the
    join's key wherever both boxes know them: each box is dealt once for each kind of partner
    (page known or not, slide known or not) that there is, which is one kind as a rule.  A pair
    is taken from the first cell that both share, so none comes twice.
    """
    b = F.col("bbox")
    own = F.col("page_number").isNotNull().cast("int") * 2 + F.col("slide_number").isNotNull().cast("int")
    extent = F.percentile_approx(F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]), 0.95)
    seen = boxes.agg(F.collect_set(own).alias("kinds"), extent.alias("extent")).first()
    kinds = sorted(seen["kinds"])  # four at most
    size = float(max(4 * vertical, 4 * horizontal, seen["extent"] or 0.0))

    def dealt(more_x: float, more_y: float, mine: str, theirs: str) -> DataFrame:
        low = lambda v, more: F.floor((v - more) / size)
        high = lambda v, more: F.floor((v + more) / size)
        cells = boxes.select(
            "document_id", "element_id", "ordinal", "bbox", "page_number", "slide_number", own.alias(mine),
            F.explode(F.array(*map(F.lit, kinds)) if kinds else F.array().cast("array<int>")).alias(theirs),
            low(b["x0"], more_x).alias("first_x"), low(b["y0"], more_y).alias("first_y"),
        )
        shared = lambda c, bit: F.when((F.col(mine).bitwiseAND(F.col(theirs)).bitwiseAND(bit)) > 0, F.col(c)).otherwise(-1)
        cells = cells.withColumns({"page": shared("page_number", 2), "slide": shared("slide_number", 1)})
        cells = cells.withColumn("cx", F.explode(F.sequence("first_x", high(b["x1"], more_x))))
        return cells.withColumn("cy", F.explode(F.sequence("first_y", high(b["y1"], more_y)))).drop("page_number", "slide_number")

    left, right = dealt(horizontal, vertical, "kind_a", "kind_b").alias("a"), dealt(0.0, 0.0, "kind_b", "kind_a").alias("b")
    same = F.lit(True)
    for c in ("document_id", "cx", "cy", "kind_a", "kind_b", "page", "slide"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    once = (F.col("a.cx") == F.greatest("a.first_x", "b.first_x")) & (F.col("a.cy") == F.greatest("a.first_y", "b.first_y"))
    pairs = left.join(right, same & once & (F.col("a.ordinal") < F.col("b.ordinal")) & G.near(F.col("a.bbox"), F.col("b.bbox"), vertical, horizontal))
    one = pairs.select(
        F.col("a.document_id").alias("document_id"), F.col("a.element_id").alias("s"), F.col("b.element_id").alias("t"),
        F.round(G.distance(F.col("a.bbox"), F.col("b.bbox")), 6).alias("distance"),
    )
    both = F.explode(F.array(F.struct(F.col("s").alias("source_element_id"), F.col("t").alias("target_element_id")),
                             F.struct(F.col("t").alias("source_element_id"), F.col("s").alias("target_element_id"))))
    return one.select("document_id", "distance", both.alias("e")).select("document_id", "e.*", F.lit("spatially_adjacent").alias("relationship_type"), "distance")


def number_of(kind: Column, text: Column) -> Column:
    return F.when(kind == "image", T.figure_number(text)).when(kind == "table", T.table_number(text))


def captions(objects: DataFrame, texts: DataFrame) -> DataFrame:
    """For each image or table the near text with a number of its kind that starts closest to its lower edge."""
    o, t = objects.alias("o"), texts.alias("t")
    number = number_of(F.col("o.kind"), F.col("t.text"))
    met = o.join(t, (F.col("o.document_id") == F.col("t.document_id")) & (F.col("o.page_number") == F.col("t.page_number"))
                 & G.near(F.col("o.bbox"), F.col("t.bbox"), *CAPTION_GAP) & number.isNotNull())
    apart = F.abs(F.col("t.bbox.y0") - F.col("o.bbox.y1"))
    best = Window.partitionBy("o.document_id", "o.element_id").orderBy(apart, F.col("t.ordinal"))
    return met.withColumn("place", F.row_number().over(best)).filter("place = 1").select(
        F.col("o.document_id").alias("document_id"), F.col("o.page_number").alias("page_number"), F.col("o.kind").alias("kind"),
        F.col("t.element_id").alias("source_element_id"), F.lit("caption_of").alias("relationship_type"),
        F.col("o.element_id").alias("target_element_id"), number.alias("number"), F.col("o.ordinal").alias("ordinal"),
    )


def references(texts: DataFrame, captioned: DataFrame) -> DataFrame:
    """``refers_to`` edges from texts that name a figure or table to the captioned object of that number on the page."""
    first = Window.partitionBy("document_id", "page_number", "kind", "number").orderBy("ordinal")
    named = captioned.withColumn("place", F.row_number().over(first)).filter("place = 1").select(
        "document_id", "page_number", "kind", "number", F.col("target_element_id")
    )
    kinds = F.array(F.struct(F.lit("image").alias("kind"), T.figure_number(F.col("text")).alias("number")),
                    F.struct(F.lit("table").alias("kind"), T.table_number(F.col("text")).alias("number")))
    said = texts.select("document_id", "page_number", F.col("element_id").alias("source_element_id"), F.explode(kinds).alias("k"))
    said = said.select("document_id", "page_number", "source_element_id", "k.kind", "k.number").filter("number is not null")
    return said.join(named, ["document_id", "page_number", "kind", "number"]).select(
        "document_id", "source_element_id", F.lit("refers_to").alias("relationship_type"), "target_element_id"
    )


def drop_inside_tables(texts: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Texts of which less than ``share`` lies in any table of their page."""
    inside = F.col("t.document_id").eqNullSafe(F.col("b.document_id")) & F.col("t.page_number").eqNullSafe(F.col("b.page_number"))
    return texts.alias("t").join(tables.alias("b"), inside & (G.overlap_ratio(F.col("t.bbox"), F.col("b.bbox")) >= share), "left_anti")


def link_texts(links: DataFrame, words: DataFrame) -> DataFrame:
    """The visible text of each link: the words of its page whose boxes share area with its box, in order."""
    on_page = (F.col("l.document_id") == F.col("w.document_id")) & (F.col("l.page_number") == F.col("w.page_number"))
    met = links.alias("l").join(words.alias("w"), on_page & (G.intersection(F.col("l.bbox"), F.col("w.bbox")) > 0))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w.ordinal", "w.text"))), lambda x: x["text"]), " ")
    return met.groupBy(F.col("l.document_id").alias("document_id"), F.col("l.element_id").alias("element_id")).agg(said.alias("text"))
