import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loamstone.errors import UnsupportedSource
from loamstone.sources import captions, html, media, office, plain, registry


def kinds(out):
    return [(e["element_id"], e["element_type"], e["text"]) for e in out.elements[1:]]


def links(out):
    return [(e["source"], e["type"], e["target"]) for e in out.edges]


def test_csv():
    out = plain.read_csv("a, b\n1,\n")
    meta = json.loads(out.elements[1]["metadata"])
    assert out.elements[1]["text"] == "a | b\n1 | "
    assert (meta["row_count"], meta["column_count"]) == (2, 2)
    assert json.loads(plain.read_csv("").elements[1]["metadata"])["row_count"] == 0
    assert links(out) == [("document", "contains", "table-1")]


def test_txt():
    assert plain.read_txt("  x \n").elements[1]["text"] == "x"
    assert plain.read_txt("").elements[1]["text"] == ""


def test_markdown():
    out = plain.read_markdown("# Title #\n\ntext [in](b.md) here\n![alt](img/x.png)\n[only](http://h/x)\n", "docs/a.md")
    assert [k[:2] for k in kinds(out)] == [("heading-1", "heading"), ("text-2", "paragraph"), ("text-2-link-1", "link"), ("image-3", "image"), ("link-4", "link")]
    assert kinds(out)[0][2] == "Title"
    assert json.loads(out.elements[3]["metadata"])["target"] == "docs/b.md"
    assert out.elements[4]["asset_path"] == "docs/img/x.png"
    assert ("text-2", "contains", "text-2-link-1") in links(out)
    assert ("document", "contains", "text-2-link-1") not in links(out)


def test_html():
    out = html.read_html("<title>T</title><article><h1>H</h1><p>a <a href='x'>l</a></p></article><script>no()</script><img data-src='i.png'><p> </p>", "http://h/d/")
    assert kinds(out) == [("heading-1", "heading", "H"), ("text-2", "paragraph", "a l"), ("link-3", "link", "l"), ("image-4", "image", None)]
    assert json.loads(out.elements[3]["metadata"])["target"] == "http://h/d/x"
    assert out.elements[4]["asset_path"] == "http://h/d/i.png"
    assert ("text-2", "contains", "link-3") in links(out)
    assert ("document", "contains", "heading-1") in links(out)


def test_html_tables_count_nested_rows_twice():
    text, rows, width = html.table_of(_table("<table><tr><td>a</td><td><table><tr><td>b</td></tr></table></td></tr><tr></tr></table>"))
    assert text == "a | b | b\nb"
    assert (rows, width) == (3, 3)


def _table(source):
    tree = html.Tree()
    tree.feed(source)
    return html.below(tree.root, {"table"})[0]


def test_html_unclosed_paragraphs_nest():
    out = html.read_html("<p>one<p>two<b>three")
    assert [k[2] for k in kinds(out)] == ["one two three", "two three"]
    assert ("text-1", "contains", "text-2") in links(out)
    assert html.read_html("").elements[0]["element_id"] == "document"
    assert html.read_html(None).edges == []


def test_captions():
    vtt = "WEBVTT\n\n1\n00:00.000 --> 00:02.000 align:start\nHello\nworld\n\n00:03.000 --> 00:04.000\n\n"
    assert captions.parse_captions(vtt) == [(0.0, 2.0, "Hello world")]
    srt = "1\n00:00:01,000 --> 00:00:03,000\nHi\n"
    assert captions.parse_captions(srt) == [(1.0, 3.0, "Hi")]


def zipped(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return data.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def docx():
    return zipped({
        "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
        '<w:p><w:r><w:t>See </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink><a:blip r:embed="r2"/></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
        "word/_rels/document.xml.rels": f'<Relationships {R}><Relationship Id="r1" Type="{TYPE}hyperlink" Target="http://h/" TargetMode="External"/>'
        f'<Relationship Id="r2" Type="{TYPE}image" Target="media/i.png"/></Relationships>',
        "word/media/i.png": "x",
    })


def test_docx():
    out = office.read_docx(docx())
    assert [k[:2] for k in kinds(out)] == [("image-1", "image"), ("paragraph-1", "heading"), ("paragraph-2", "paragraph"), ("link-1", "link"), ("table-1", "table")]
    assert out.elements[5]["text"] == "a | b"
    assert ("paragraph-2", "contains", "image-1") in links(out)
    assert sum(e["source"] == "document" for e in out.edges) == 5


def test_pptx():
    p = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shape = lambda kind, said: f'<p:sp><p:nvPr><p:ph type="{kind}"/></p:nvPr><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{said}</a:t></a:r></a:p></p:txBody></p:sp>'
    data = zipped({"ppt/slides/slide1.xml": f"<p:sld {p}><p:cSld><p:spTree>{shape('title', 'Top')}{shape('body', 'Text')}</p:spTree></p:cSld></p:sld>"})
    out = office.read_pptx(data)
    assert [(k[1], k[2]) for k in kinds(out)] == [("slide", "Top"), ("heading", "Top"), ("text", "Text")]
    assert json.loads(out.elements[2]["metadata"])["bbox"] == {"left": 1, "top": 2, "width": 3, "height": 4}
    assert ("slide-1", "contains", "slide-1-shape-2") in links(out)


def test_xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = zipped({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="r1" Type="{TYPE}worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><f>A1+1</f><v>2</v></c></row><row><c r="A2"><v> </v></c></row></sheetData></worksheet>',
    })
    out = office.read_xlsx(data)
    assert [k[1] for k in kinds(out)] == ["workbook", "sheet", "table"]
    assert out.elements[3]["text"] == "name |  | =A1+1"


def test_registry(spark):
    files = spark.createDataFrame([("a", "x/a.TXT", b"hi"), ("b", "x/b.html", b"<h1>T</h1>"), ("c", "x/c.docx", docx()), ("d", "x/d.png", b""), ("e", "x/e.srt", b"1\n00:00:01,000 --> 00:00:02,000\nHi\n")], "document_id string, path string, content binary")
    elements, edges = registry.load(registry.require_supported(files))
    found = {(r["document_id"], r["element_type"]) for r in elements.collect()}
    assert {("a", "text"), ("b", "heading"), ("c", "table"), ("d", "image"), ("e", "transcript")} <= found
    assert edges.filter("document_id = 'd'").count() == 1
    with pytest.raises(UnsupportedSource):
        registry.require_supported(files.withColumn("path", F.lit("x.gif")))


def test_plug_ins(spark):
    images = spark.createDataFrame([("d", "i", 0, "image", "image", "p.png")], "document_id string, element_id string, ordinal int, element_type string, content_kind string, asset_path string")
    said = lambda path: media.description(F.struct(F.lit("a cat").alias("description"), F.lit("").alias("ocr_text"), F.array(F.lit("cat"), F.lit("mat")).alias("visual_elements"), F.lit(None).cast("string").alias("document_context")))
    made, edges = media.describe(images, said)
    assert made.first()["text"] == "a cat\nVisual elements: cat, mat"
    assert edges.first()["source_element_id"] == "i:semantic"
    with pytest.raises(Exception, match="no description"):
        media.describe(images, lambda path: F.lit(" "))[0].collect()
    files = spark.createDataFrame([("d", "a.wav")], "document_id string, path string")
    heard = lambda path: F.array(F.struct(F.lit(0.0).alias("start_seconds"), F.lit(1.0).alias("end_seconds"), F.lit(" hi ").alias("text")), F.struct(F.lit(1.0).alias("start_seconds"), F.lit(2.0).alias("end_seconds"), F.lit(" ").alias("text")))
    assert [r["text"] for r in media.transcripts(files, heard).collect()] == ["hi"]


def test_key_frames(spark):
    rows = spark.createDataFrame([("v", 0.0, 0.0), ("v", 1.0, 90.0), ("v", 2.5, 30.0), ("v", 3.0, 90.0), ("v", 5.0, 10.0)], "document_id string, timestamp_seconds double, difference double")
    assert [r["timestamp_seconds"] for r in captions.key_frames(rows).orderBy("timestamp_seconds").collect()] == [0.0, 2.5]


def test_caption_rows_keep_numbers(spark):
    rows = spark.createDataFrame([("v", 0, 0.0, 1.0, "a"), ("v", 1, 1.0, 1.0, " "), ("v", 2, 2.0, 2.0, "b")], "document_id string, pos int, start double, duration double, text string")
    assert [(r["segment_index"], r["end_seconds"]) for r in captions.caption_rows(rows).orderBy("segment_index").collect()] == [(1, 1.0), (3, 4.0)]


def test_assets_and_point_ids(spark):
    import uuid

    from loamstone.functions.text import point_id

    files = spark.createDataFrame([("c", docx())], "document_id string, content binary")
    assert [(r["asset_path"], bytes(r["bytes"])) for r in media.asset_table(files).collect()] == [("word/media/i.png", b"x")]
    assert files.select(point_id("k", F.lit("c1")).alias("p")).first()["p"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "k:c1"))


def files_of(spark, *rows):
    return spark.createDataFrame([(f"d{n}", path, body) for n, (path, body) in enumerate(rows)], "document_id string, path string, content binary")


def test_one_bad_file_fails_alone(spark):
    found = registry.load_all(files_of(spark, ("a.docx", b"broken"), ("b.txt", b"fine"), ("c.pdf", b"%PDF"), ("d.srt", b"1\n00:xx --> 00:02\nno\n"), ("e.gif", b""), ("f.png", b"x")))
    errors = {r["document_id"]: r["error"] for r in found.failures.collect()}
    assert set(errors) == {"d0", "d2", "d3", "d4"}
    assert "BadZipFile" in errors["d0"]
    assert "plug-in" in errors["d2"]
    assert {r["document_id"] for r in found.elements.collect()} == {"d1", "d5"}


LAYOUT = [
    (1, "text", "Intro text", None, (0.0, 0.0, 100.0, 20.0)), (1, "image", None, "i.png", (0.0, 30.0, 100.0, 100.0)),
    (1, "text", "Figure 1: a wheel", None, (0.0, 105.0, 100.0, 120.0)), (1, "text", "as in Figure 1 above", None, (0.0, 130.0, 100.0, 150.0)),
    (2, "table", "a | b", None, (0.0, 0.0, 200.0, 100.0)), (2, "text", "a inside", None, (10.0, 10.0, 50.0, 20.0)), (2, "text", "below", None, (300.0, 600.0, 400.0, 620.0)),
    (2, "link", None, "http://x", (300.0, 600.0, 350.0, 620.0)),
]


def test_pdf_through_a_layout_plugin(spark):
    block = lambda b: F.struct(
        F.lit(b[0]).alias("page_number"), F.lit(b[1]).alias("kind"), F.lit(b[2]).cast("string").alias("text"), F.lit(b[3]).cast("string").alias("asset_path"),
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), b[4], strict=True)]).alias("bbox"),
    )
    found = registry.load_all(files_of(spark, ("a.pdf", b"%PDF")), media.Plugins(layout=lambda path: F.when(path.isNotNull(), F.array(*map(block, LAYOUT)))))
    assert found.failures.count() == 0
    elements = {r["element_id"]: r for r in found.elements.collect()}
    assert [e["element_type"] for e in sorted(elements.values(), key=lambda e: e["ordinal"])] == ["document", "page", "page", "paragraph", "image", "paragraph", "paragraph", "table", "paragraph", "link"]
    assert not [e for e in elements.values() if e["text"] == "a inside"]
    assert next(e for e in elements.values() if e["element_type"] == "link")["text"] == "below"
    edges = {(r["source_element_id"], r["relationship_type"], r["target_element_id"]) for r in found.relationships.collect()}
    assert ("document", "contains", "page-1") in edges
    assert ("page-1", "contains", "page-1-image-1") in edges
    assert ("page-1-text-2", "caption_of", "page-1-image-1") in edges
    assert ("page-1-text-3", "refers_to", "page-1-image-1") in edges
    assert ("page-1-text-0", "spatially_adjacent", "page-1-image-1") in edges


def test_video_takes_captions_first(spark):
    vtt = b"WEBVTT\n\n00:00.000 --> 00:02.000\nbeside\n"
    said = lambda text: F.array(F.struct(F.lit(0.0).alias("start_seconds"), F.lit(5.0).alias("end_seconds"), F.lit(text).alias("text")))
    frame = lambda t, d: F.struct(F.lit(t).alias("timestamp_seconds"), F.concat(F.lit("f"), F.lit(str(t))).alias("asset_path"), F.lit(d).alias("difference"))
    plugins = media.Plugins(
        recognise=lambda path: F.when(path.endswith(".wav"), said("heard")).otherwise(said("heard in sound file")),
        embedded_captions=lambda path: F.when(path.endswith("b.mp4"), F.lit("1\n00:00:01,000 --> 00:00:03,000\ninside\n")),
        audio_track=lambda path: F.concat(path, F.lit(".wav")),
        frames=lambda path: F.when(path.isNotNull(), F.array(frame(0.0, 0.0), frame(1.0, 90.0), frame(4.0, 90.0), frame(60.0, 10.0), frame(90.0, 30.0))),
    )
    files = files_of(spark, ("v/a.mp4", b""), ("v/a.vtt", vtt), ("v/b.mp4", b""), ("v/c.mp4", b""), ("v/d.mp3", b""))
    found = registry.load_all(files, plugins)
    spoken = {r["document_id"]: r["text"] for r in found.elements.filter("element_type = 'transcript'").collect()}
    assert spoken == {"d0": "beside", "d1": "beside", "d2": "inside", "d3": "heard", "d4": "heard in sound file"}
    frames = sorted(r["asset_path"] for r in found.elements.filter("element_type = 'video_frame' and document_id = 'd3'").collect())
    assert frames == ["f0.0", "f4.0", "f90.0"]
    edges = {(r["source_element_id"], r["relationship_type"], r["target_element_id"]) for r in found.relationships.filter("document_id = 'd3'").collect()}
    assert {("video-1", "contains", "transcript-1"), ("transcript-1", "temporally_adjacent", "frame-1"), ("frame-2", "temporally_adjacent", "transcript-1")} <= edges
    assert ("transcript-1", "temporally_adjacent", "frame-3") not in edges


def test_images_are_described(spark):
    found = registry.load_all(files_of(spark, ("a.png", b"x")), media.Plugins(vision=lambda path: F.concat(F.lit("shows "), path)))
    made = found.elements.filter("element_type = 'image_semantic'").first()
    assert (made["element_id"], made["text"]) == ("image-1:semantic", "shows a.png")
    assert found.relationships.filter("relationship_type = 'derived_from'").first()["target_element_id"] == "image-1"


def test_assets_are_written(spark, tmp_path):
    files = files_of(spark, ("a.docx", docx()))
    stored = media.write_assets(media.asset_table(files), f"file://{tmp_path}/assets")
    assert [(r["asset_path"], r["size"]) for r in stored.collect()] == [("word/media/i.png", 1)]


def test_frame_differences(spark):
    frames = spark.createDataFrame([("v", 1.0, [2.0, 4.0]), ("v", 0.0, [0.0, 0.0]), ("w", 0.0, [1.0, 1.0])], "document_id string, timestamp_seconds double, levels array<double>")
    got = {(r[0], r[1]): r[2] for r in captions.frame_differences(frames).collect()}
    assert got == {("v", 0.0): None, ("v", 1.0): 3.0, ("w", 0.0): None}


def test_shapes_of_a_slide_are_adjacent(spark):
    p = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shape = lambda x, said: f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="0"/><a:ext cx="900000" cy="500000"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{said}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f"<p:sld {p}><p:cSld><p:spTree>{shape(0, 'one')}{shape(900050, 'two')}{shape(3000000, 'three')}</p:spTree></p:cSld></p:sld>"
    files = files_of(spark, ("a.pptx", zipped({"ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": slide})))
    near = registry.load_all(files).relationships.filter("relationship_type = 'spatially_adjacent'").collect()
    assert {(r["source_element_id"], r["target_element_id"]) for r in near} == {
        (f"slide-{n}-shape-{a}", f"slide-{n}-shape-{b}") for n in (1, 2) for a, b in ((1, 2), (2, 1))
    }
