"""Queries of loaders, media, enrichment and stored tables, over files made from the driver's tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import metadata as M
from ..functions import text as T
from ..operators import evaluation, postings, relationships, retrieval
from ..operators.store import Store, latest
from ..scratch import scratch
from ..sources import captions, loaded, media, registry
from ..streaming.ingest import ingest
from . import views

SHA = lambda c: F.sha2(c.cast("binary"), 256)


def _turn_files(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    """Every turn of a conversation as a text file."""
    turns = views.table(spark, sf_dir, "conversations")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(name.alias("document_id"), F.concat(F.lit("in/"), name, F.lit(suffix)).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


TURNS = "turns as (select conv_id || '-' || turn as document_id, coalesce(text, '') as t, * exclude (text) from conversations)"
BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def txt_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files through the registry: elements and the edge from the root."""
    elements, edges = registry.load(_turn_files(spark, sf_dir, ".TXT"))
    held = edges.select("document_id", F.col("target_element_id").alias("element_id"), F.col("source_element_id").alias("parent"))
    return elements.join(held, ["document_id", "element_id"], "left").select("document_id", "element_id", "ordinal", "element_type", SHA(F.col("text")).alias("text_sha256"), "parent")


TXT = rf"""with {TURNS} select document_id, 'document' as element_id, 0::int as ordinal, 'document' as element_type, sha256('') as text_sha256, null as parent from turns
 union all select document_id, 'text-1', 1::int, 'text', sha256({BARE.format('t')}), 'document' from turns"""


def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, links, images and paragraphs with their ids, levels, targets and parents."""
    k = F.col("p_partkey").cast("string")
    level = (F.col("p_partkey") % 6 + 1).cast("int")
    text = F.concat(
        F.expr("repeat('#', cast(p_partkey % 6 + 1 as int))"), F.lit(" "), "p_name", F.lit("\n\n![pic](../img/"), k, F.lit('.png "t")\n[page]('),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("HTTP://h/"), k)).otherwise(F.concat(F.lit("./sub/../q"), k, F.lit(".md"))),
        F.lit(")\n- see [in](a/"), k, F.lit(") and ![no](x)\n"),
    )
    files = views.table(spark, sf_dir, "part").select(k.alias("document_id"), text.alias("text"), F.lit("docs/deep/f.md").alias("path"), level.alias("level"))
    elements, edges = loaded.tables(loaded.parse(files, registry.PARSERS["markdown"][0], "text", "path"))
    held = edges.select("document_id", F.col("target_element_id").alias("element_id"), F.col("source_element_id").alias("parent"))
    found = elements.filter("element_type <> 'document'").join(held, ["document_id", "element_id"], "left")
    return found.select("document_id", "element_id", "element_type", "text", F.coalesce(M.get(F.col("metadata"), "level").cast("int"), F.lit(0)).alias("level"),
                        F.coalesce(M.get(F.col("metadata"), "target"), "asset_path").alias("target"), "parent")


MARKDOWN_ROWS = """with p as (select cast(p_partkey as varchar) as k, cast(p_partkey % 6 + 1 as int) as l, p_partkey % 2 as odd, p_name as n from part)
 select k as document_id, 'heading-1' as element_id, 'heading' as element_type, n as text, l as level, null as target, 'document' as parent from p
 union all select k, 'image-2', 'image', null, 0, 'docs/img/' || k || '.png', 'document' from p
 union all select k, 'link-3', 'link', 'page', 0, case when odd = 0 then 'HTTP://h/' || k else 'docs/deep/q' || k || '.md' end, 'document' from p
 union all select k, 'text-4', 'paragraph', '- see [in](a/' || k || ') and ![no](x)', 0, null, 'document' from p
 union all select k, 'text-4-link-1', 'link', 'in', 0, 'docs/deep/a/' || k, 'text-4' from p"""


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages: each link with its address resolved against the page's, and the element that contains it."""
    pages = views.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), "url", "html")
    elements, edges = registry.read_pages(pages)
    held = edges.select("document_id", F.col("target_element_id").alias("element_id"), F.col("source_element_id").alias("parent"))
    found = elements.filter("element_type in ('link', 'heading')").join(held, ["document_id", "element_id"], "left")
    return found.select("document_id", "element_id", M.get(F.col("metadata"), "target").alias("target"), "parent")


PAGE_EDGES = r"""with p as (select cast(page_id as varchar) as d, url, regexp_extract_all(html, '<li><a href="([^"]+)">', 1) as li from pages),
 l as (select d, url, unnest(li) as href, unnest(range(1, len(li) + 1)) as i from p)
 select d as document_id, 'link-' || 2 * i as element_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href as target, 'text-' || (2 * i - 1) as parent from l
 union all select d, 'heading-' || (2 * len(li) + 1), null, 'document' from p"""


# ---- Office files ----


def _zipped(parts: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return data.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELATIONS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def _docx(head: str, rows: list[list[str]]) -> bytes:
    para = lambda t, style="": f"<w:p>{style}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    title = para(head, '<w:pPr><w:pStyle w:val="Heading 2"/></w:pPr>')
    table = "".join(f"<w:tr>{''.join(f'<w:tc>{para(c)}</w:tc>' for c in r)}</w:tr>" for r in rows)
    return _zipped({"word/document.xml": f"<w:document {W}><w:body>{title}{''.join(para(r[1]) for r in rows)}<w:tbl>{table}</w:tbl></w:body></w:document>"})


def _pptx(head: str, rows: list[list[str]]) -> bytes:
    shape = lambda kind, t: f'<p:sp><p:nvPr><p:ph type="{kind}"/></p:nvPr><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>'
    slides = {f"ppt/slides/slide{n}.xml": f"<p:sld {P}><p:cSld><p:spTree>{shape('title', r[1])}{shape('body', r[2])}</p:spTree></p:cSld></p:sld>" for n, r in enumerate(rows, start=1)}
    return _zipped(slides)


def _xlsx(head: str, rows: list[list[str]]) -> bytes:
    cells = "".join(f'<row>{"".join(f"""<c r="{chr(65 + n)}1"><v>{escape(c)}</v></c>""" for n, c in enumerate(r))}</row>' for r in rows)
    return _zipped({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="{escape(head)}" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {RELATIONS}><Relationship Id="r1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>",
    })


def _office(spark: SparkSession, sf_dir: str, suffix: str, make) -> DataFrame:
    """Customers of each nation as an Office file, read back as elements."""

    def built(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for heads, rows in batches:
            yield pd.Series([make(h, [list(r) for r in x]) for h, x in zip(heads, rows, strict=True)])

    row = F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"))
    groups = views.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("rows"))
    name = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    content = F.pandas_udf(built, "binary")(name, F.transform("rows", lambda x: x["row"]))
    files = groups.select(F.col("c_nationkey").cast("string").alias("document_id"), F.lit(f"x{suffix}").alias("path"), content.alias("content"))
    return registry.load(files)[0]


def _told(elements: DataFrame, *kinds: str) -> DataFrame:
    """For each kind of element how many there are, and a digest of their texts in order."""
    own = elements.filter(F.col("element_type").isin(*kinds)).groupBy("document_id", "element_type")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n")
    return own.agg(F.count("*").alias("n"), SHA(texts).alias("texts_sha256"))


def docx_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_office(spark, sf_dir, ".docx", _docx), "heading", "paragraph", "table")


def pptx_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_office(spark, sf_dir, ".pptx", _pptx), "slide", "heading", "text")


def xlsx_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_office(spark, sf_dir, ".xlsx", _xlsx), "workbook", "sheet", "table")


_PER = "select cast(c_nationkey as varchar) as document_id, '{kind}' as element_type, {n} as n, sha256({text}) as texts_sha256 from customer group by c_nationkey"
_ROW = "string_agg(c_custkey || ' | ' || c_name || ' | ' || c_mktsegment, chr(10) order by c_custkey)"
_LINES = lambda c: f"string_agg({c}, chr(10) order by c_custkey)"
OFFICE = {
    "docx": [("heading", "1", "'nation ' || c_nationkey"), ("paragraph", "count(*)", _LINES("c_name")), ("table", "1", _ROW)],
    "pptx": [("slide", "count(*)", _LINES("c_name")), ("heading", "count(*)", _LINES("c_name")), ("text", "count(*)", _LINES("c_mktsegment"))],
    "xlsx": [("workbook", "1", "''"), ("sheet", "1", "''"), ("table", "1", _ROW)],
}
OFFICE_SQL = {kind: " union all ".join(_PER.format(kind=k, n=n, text=t) for k, n, t in rows) for kind, rows in OFFICE.items()}


# ---- media ----


def asset_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, sound and video without plug-ins: asset elements and their edges."""
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".AAC", ".webm"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    files = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), suffix).alias("path"), F.lit(b"").alias("content"))
    elements, edges = registry.load(files)
    return elements.join(edges.select("document_id", F.col("target_element_id").alias("element_id"), "relationship_type"), ["document_id", "element_id"]).select(
        "document_id", "element_id", "ordinal", "element_type", "content_kind", "asset_path", "relationship_type"
    )


ASSETS = """with p as (select p_partkey as k, ['image', 'audio', 'video'][cast(p_partkey % 3 + 1 as int)] as kind, ['.jpg', '.AAC', '.webm'][cast(p_partkey % 3 + 1 as int)] as suffix from part)
 select cast(k as varchar) as document_id, kind || '-1' as element_id, 1::int as ordinal, kind as element_type, kind as content_kind, 'm/' || k || suffix as asset_path, 'contains' as relationship_type from p"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows of captions, five seconds apart; every seventh is blank."""
    text = F.when(F.col("turn") % 7 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))
    return views.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("pos"), (F.col("turn") * 5.0).alias("start"), F.lit(4.0).alias("duration"), text.alias("text")
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements from a recogniser's segments: blank ones are dropped, the others keep their numbers."""
    rows = _said(spark, sf_dir)
    one = F.struct("pos", F.struct(F.col("start").alias("start_seconds"), (F.col("start") + F.col("duration")).alias("end_seconds"), "text").alias("s"))
    files = rows.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("heard"))
    elements, _ = media.spoken(files, F.col("heard"), "audio-1")
    return elements.select("document_id", "element_id", SHA(F.col("text")).alias("text_sha256"), M.get(F.col("metadata"), "end_seconds").cast("double").alias("end_seconds"))


def caption_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements from rows of captions: numbers count before blank ones go."""
    found = captions.caption_rows(_said(spark, sf_dir))
    return found.select("document_id", "element_id", SHA(F.col("text")).alias("text_sha256"), "end_seconds")


SPOKEN = """select cast(conv_id as varchar) as document_id, 'transcript-' || n as element_id, sha256(trim(text)) as text_sha256, turn * 5.0 + 4 as end_seconds
 from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) where turn % 7 <> 3 and trim(text) <> ''"""


def frame_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of each event of a user to the one before, as two grey levels."""
    frames = views.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("document_id"), F.col("event_id").cast("double").alias("timestamp_seconds"), F.array("value", F.col("value") * 3).alias("levels")
    )
    return captions.frame_differences(frames).select("document_id", "timestamp_seconds", F.round("difference", 6).alias("difference"))


DIFFERENCES = """with e as (select user_id, event_id, value, lag(value) over (partition by user_id order by event_id) as b from events)
 select cast(user_id as varchar) as document_id, cast(event_id as double) as timestamp_seconds, round((abs(value - b) + abs(value * 3 - b * 3)) / 2, 6) as difference from e"""


def enriched_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with what a vision plug-in says of images, and the edges back to them."""
    elements, edges = views.elements(spark, sf_dir), views.edges(spark, sf_dir).withColumn("metadata", F.lit("{}"))
    images = F.col("content_kind") == "image"
    shown = elements.withColumn("element_type", F.when(images, "image").otherwise(F.col("element_type"))).withColumn("asset_path", F.when(images, F.concat(F.lit("img/"), "element_id")).otherwise(F.col("asset_path")))
    visual = lambda path: media.description(F.struct(
        F.concat(F.lit("shows "), path).alias("description"), F.lit(" ").alias("ocr_text"), F.array(F.lit("box"), path).alias("visual_elements"), F.lit("manual").alias("document_context"),
    ))
    more, links = media.enriched(shown, edges, visual)
    made = more.filter("element_type = 'image_semantic'")
    back = links.filter("relationship_type = 'derived_from'").select("document_id", F.col("source_element_id").alias("element_id"), F.col("target_element_id").alias("image"))
    return made.join(back, ["document_id", "element_id"]).select("document_id", "element_id", "text", "image")


ENRICHED = """select source as document_id, doc_id || ':semantic' as element_id, 'shows img/' || doc_id || chr(10) || 'Visual elements: box, img/' || doc_id || chr(10) || 'Context: manual' as text,
 cast(doc_id as varchar) as image from documents where doc_id % 13 = 0 and doc_id % 11 <> 0"""


def boxes_in_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a page that do not lie in one of its tables."""
    objects, texts = views.layout(spark, sf_dir)
    wide = objects.filter("kind = 'table'").withColumn("bbox", G.bbox(F.col("bbox.x0") - 40, F.col("bbox.y0") - 40, F.col("bbox.x1") + 40, F.col("bbox.y1") + 40))
    return relationships.drop_inside_tables(texts, wide).select("document_id", "element_id")


OUTSIDE = f"""with {views.layout_sql()}, wide as (select page, x0 - 40 as x0, y0 - 40 as y0, x1 + 40 as x1, y1 + 40 as y1 from objects where kind = 'table')
 select 'parts' as document_id, cast(k as varchar) as element_id from texts t where not exists (select 1 from wide b where b.page = t.page and
  greatest(least(t.x1, b.x1) - greatest(t.x0, b.x0), 0) * greatest(least(t.y1, b.y1) - greatest(t.y0, b.y0), 0) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.5)"""


def box_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as JSON in three encodings, and as none, read back."""
    k = F.col("p_partkey")
    x, y, w, h = k % 600, k % 800, k % 60 + 1, k % 30 + 1
    kinds = [
        F.to_json(F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))), F.to_json(F.struct(x.alias("left"), y.alias("top"), w.alias("width"), h.alias("height"))),
        F.to_json(F.array(x, y, x + w, y + h)), F.to_json(F.struct(x.alias("x0"))),
    ]
    box = G.from_json(F.element_at(F.array(*kinds), (k % 4 + 1).cast("int")))
    return views.table(spark, sf_dir, "part").select("p_partkey", box["x0"].alias("x0"), box["y1"].alias("y1"), G.area(box).alias("area"))


ENCODINGS = """select p_partkey, case when p_partkey % 4 < 3 then cast(p_partkey % 600 as double) end as x0, case when p_partkey % 4 < 3 then cast(p_partkey % 800 + p_partkey % 30 + 1 as double) end as y1,
 case when p_partkey % 4 < 3 then cast((p_partkey % 60 + 1) * (p_partkey % 30 + 1) as double) else 0.0 end as area from part"""


# ---- stored tables ----


def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as files through the whole chain into a store: what each stored document has then."""
    kept = Store(spark, scratch(spark, "ingested"))
    ingest(kept, _turn_files(spark, sf_dir, ".txt"), 4000, 0)
    chunks = kept.read("chunks").select("document_id", "chunk_index", SHA(F.col("content")).alias("content_sha256"))
    state = kept.read("documents").select("document_id", F.col("metadata")["processing_status"].alias("status"))
    return state.join(chunks, "document_id", "left")


INGESTED = rf"""with {TURNS} select document_id, 'completed' as status, 0::int as chunk_index,
 sha256({BARE.format(r"regexp_replace(regexp_replace(nfc_normalize(t), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) as content_sha256 from turns"""


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and edges persisted, one source replaced, one deleted, vectors upserted: what is stored then."""
    kept = Store(spark, scratch(spark, "stored"))
    elements = views.elements(spark, sf_dir)
    edges = views.chain_edges(spark, sf_dir).withColumn("metadata", F.lit("{}"))
    documents = elements.select("document_id").distinct().select("document_id", F.create_map(F.lit("state"), F.lit("old"), F.lit("kept"), F.lit("1")).alias("metadata"))
    kept.persist(documents, elements, edges)
    again = documents.filter("document_id = 'src3'").withColumn("metadata", F.create_map(F.lit("state"), F.lit("new")))
    kept.persist(again, elements.filter("document_id = 'src3' and ordinal % 2 = 0"), edges.limit(0), allow_existing=True)
    kept.delete_documents(["src5"], "elements", "relationships", "documents")
    counted = lambda name: kept.read(name).groupBy("document_id").agg(F.count("*").alias(name))
    state = kept.read("documents").select("document_id", F.col("metadata")["state"].alias("state"), F.col("metadata")["kept"].alias("kept"))
    joined = state.join(counted("elements"), "document_id", "left").join(counted("relationships"), "document_id", "left")
    return joined.select("document_id", "state", "kept", F.coalesce("elements", F.lit(0)).alias("elements"), F.coalesce("relationships", F.lit(0)).alias("relationships"))


STORED = """with e as (select source, count(*) as n, count(*) filter (doc_id % 2 = 0) as even from documents where source is not null group by 1)
 select source as document_id, case when source = 'src3' then 'new' else 'old' end as state, '1' as kept, case when source = 'src3' then even else n end as elements,
  case when source = 'src3' then 0 else greatest(n - 4, 0) end as relationships from e where source <> 'src5'"""


def upserted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored twice, every third changed: the latest stays, and a later label moves a chunk's document."""
    kept = Store(spark, scratch(spark, "upserted"))
    first = views.vector_chunks(spark, sf_dir).select("chunk_id", "document_id", "embedding")
    kept.upsert_chunks(first)
    kept.upsert_chunks(first.filter("cast(chunk_id as long) % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    return kept.read("chunks").select("chunk_id", "document_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("head"))


UPSERTED = "select cast(vec_id as varchar) as chunk_id, cast(label as varchar) as document_id, round(cast(embedding[1] * case when vec_id % 3 = 0 then 2 else 1 end as double), 5) as head from embeddings"


def state_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States appended in bulk, some documents failed, one set back to pending: the latest of each, errors of failed ones only."""
    kept = Store(spark, scratch(spark, "states"))
    ids = views.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), (F.col("page_id") % 5 == 0).alias("bad"))
    kept.set_statuses(ids.select("document_id", F.lit("pending").alias("status"), F.lit("no").alias("error")))
    kept.set_statuses(ids.select("document_id", F.when(F.col("bad"), "failed").otherwise("completed").alias("status"), F.lit("why").alias("error")))
    kept.retry("5")
    return latest(kept.read("document_states"), "document_id").select("document_id", "status", "error")


RETRIES = """select cast(page_id as varchar) as document_id, case when page_id = 5 then 'pending' when page_id % 5 = 0 then 'failed' else 'completed' end as status,
 case when page_id <> 5 and page_id % 5 = 0 then 'why' end as error from pages"""


def chat_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats and their documents in a store: attached twice, some detached; which are left, in their order."""
    kept = Store(spark, scratch(spark, "chats"))
    chats = [kept.create_chat(f" chat {n} ") for n in range(2)]
    ids = views.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"))
    kept.write("documents", ids)
    for n, chat in enumerate(chats):
        kept.attach_all(chat, ids.filter(f"cast(document_id as long) % 2 = {n}"))
        kept.attach_all(chat, ids.filter(f"cast(document_id as long) % 4 = {n}"))
        kept.detach(chat, str(n))
    out = None
    for n, chat in enumerate(chats):
        part = kept.chat_documents(chat).select(F.lit(kept.chat(chat)["title"]).alias("title"), "document_id")
        out = part if out is None else out.unionByName(part)
    return out


CHATS = "select 'chat ' || (page_id % 2) as title, cast(page_id as varchar) as document_id from pages where page_id > 1"


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", T.point_id("c", F.col("doc_id").cast("string")).alias("point"))


POINTS = """with s as (select doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('c:' || doc_id)) as h from documents)
 select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (position(substr(h, 17, 1) in '0123456789abcdef') - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point from s"""


# ---- golden sets, writers ----


def golden_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of a golden corpus (every document's) with the first stored chunk of equal content."""
    chunks = views.document_chunks(spark, sf_dir)
    golden = chunks.select(F.concat(F.lit("g"), "chunk_id").alias("golden_id"), "content")
    return evaluation.matched_by_content(golden, chunks)


GOLDEN = "select 'g' || doc_id as golden_id, min(cast(doc_id as varchar)) over (partition by coalesce(text, '')) as chunk_id from documents"


def golden_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden corpus as one-chunk documents, and its judgements under the ids that the chunks get."""
    corpus = views.benchmark_queries(spark, sf_dir).select(F.col("query_id").alias("golden_id"), F.col("text").alias("content"))
    queries = corpus.select(F.col("golden_id").alias("query_id"), F.array("golden_id").alias("relevant"))
    chunks = evaluation.golden_chunks(corpus)
    return evaluation.golden_qrels(queries).join(chunks, "chunk_id").select("query_id", "chunk_id", "document_id", "chunk_index")


GOLDEN_IDS = "select cast(item_id as varchar) as query_id, sha256(item_id || ':0') as chunk_id, cast(item_id as varchar) as document_id, 0::int as chunk_index from benchmark"


def written_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three further queries of a writer that answers with JSON, cleaned: blank ones and repetitions go."""
    said = lambda text: F.to_json(F.struct(F.array(F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.concat(F.lit(" again: "), text), F.lit("  ")).alias("queries")))
    asked = views.benchmark_queries(spark, sf_dir).withColumn("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return retrieval.variants(asked, retrieval.written_variants(asked, said)).select("query_id", "pos", SHA(F.lower("text")).alias("text_sha256"))


WRITTEN = r"""with q as (select cast(item_id as varchar) as i, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') as t from benchmark)
 select i || '#0' as query_id, 0::int as pos, sha256(t) as text_sha256 from q where t <> '' union all select i || '#2', 2::int, sha256('again: ' || t) from q"""


def index_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all chunks in the stored index, and the mean that its manifest gives."""
    index = views.document_index(spark, sf_dir)
    n, mean = index.figures()
    return index.members().select("chunk_id", "size", F.lit(n).cast("long").alias("chunks"), F.lit(round(mean, 6)).alias("mean"))


MEMBERS = r"""with w as (select doc_id, len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as size from documents)
 select cast(doc_id as varchar) as chunk_id, cast(size as int) as size, (select count(*) from w) as chunks, round((select avg(size) from w), 6) as mean from w"""


def postings_of_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists of the benchmark's terms, read from their buckets."""
    asked = views.benchmark_queries(spark, sf_dir).select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    found = views.document_index(spark, sf_dir).lists(asked)
    return postings.frequencies(found).select("term", "df", "uses")


LISTS = r"""with words as (select doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) as term from documents),
 asked as (select distinct unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) as term from benchmark)
 select term, count(distinct doc_id) as df, count(*) as uses from words where term <> '' and term in (select term from asked) group by 1"""


QUERIES: dict[str, tuple] = {
    "txt_elements": (txt_elements, TXT),
    "markdown_rows": (markdown_rows, MARKDOWN_ROWS),
    "page_edges": (page_edges, PAGE_EDGES),
    "docx_elements": (docx_elements, OFFICE_SQL["docx"]),
    "pptx_elements": (pptx_elements, OFFICE_SQL["pptx"]),
    "xlsx_elements": (xlsx_elements, OFFICE_SQL["xlsx"]),
    "asset_elements": (asset_elements, ASSETS),
    "transcripts": (transcripts, SPOKEN),
    "caption_numbering": (caption_numbering, SPOKEN),
    "frame_differences": (frame_differences, DIFFERENCES),
    "enriched_images": (enriched_images, ENRICHED),
    "boxes_in_table": (boxes_in_table, OUTSIDE),
    "box_encodings": (box_encodings, ENCODINGS),
    "ingested_chunks": (ingested_chunks, INGESTED),
    "store_round_trip": (store_round_trip, STORED),
    "upserted_vectors": (upserted_vectors, UPSERTED),
    "state_retries": (state_retries, RETRIES),
    "chat_life": (chat_life, CHATS),
    "point_ids": (point_ids, POINTS),
    "golden_matches": (golden_matches, GOLDEN),
    "golden_ids": (golden_ids, GOLDEN_IDS),
    "written_queries": (written_queries, WRITTEN),
    "index_members": (index_members, MEMBERS),
    "postings_of_terms": (postings_of_terms, LISTS),
}
