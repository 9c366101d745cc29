import pytest
from pyspark.sql import functions as F

from loamstone.functions import geometry, metadata, paths, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("Hello\r\nWorld\rTest", "Hello\nWorld\nTest"), ("a\n\n\n\nb", "a\n\nb"), ("Café", "Café"), ("   Hello   world   ", "Hello   world"), ("a\x07b​c", "abc"), ("", "")],
)
def test_normalize(spark, raw, clean):
    assert text.normalize(raw) == clean
    assert text.normalize(clean) == clean
    assert one(spark, text.normalize_text(F.lit(raw))) == clean


def test_normalize_null(spark):
    assert one(spark, text.normalize_text(F.lit(None).cast("string"))) is None


def test_ids(spark):
    import hashlib

    assert one(spark, text.chunk_id(F.lit("doc"), F.lit(3))) == hashlib.sha256(b"doc:3").hexdigest()
    assert one(spark, text.canonical_id(F.lit("d"), F.lit("e"))) == "d:e"


@pytest.mark.parametrize(("stamp", "seconds"), [("00:02.500", 2.5), ("01:00:01,000", 3601.0), ("x", None), ("1:2:3:4", None)])
def test_caption_seconds(spark, stamp, seconds):
    assert one(spark, text.caption_seconds(F.lit(stamp))) == seconds


@pytest.mark.parametrize(("raw", "clean"), [('```sql\nfind it\n```', "find it"), ('  "quoted"  ', "quoted"), ("'a' and 'b'", "a' and 'b"), ("plain", "plain")])
def test_clean_query(spark, raw, clean):
    assert one(spark, text.clean_query(F.lit(raw))) == clean


def test_reference_numbers(spark):
    assert one(spark, text.figure_number(F.lit("see FIG. 3.1 and Figure 4"))) == "3.1"
    assert one(spark, text.table_number(F.lit("Table 12: x"))) == "12"
    assert one(spark, text.table_number(F.lit("stable 12"))) is None


def test_boxes(spark):
    a = geometry.bbox(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    b = geometry.from_json(F.lit('{"left": 5, "top": 5, "width": 10, "height": 10}'))
    c = geometry.from_json(F.lit("[20, 0, 30, 10]"))
    assert one(spark, geometry.intersection(a, b)) == 25.0
    assert one(spark, geometry.overlap_ratio(a, b)) == 0.25
    assert one(spark, geometry.gap(a, c, "x")) == 10.0
    assert one(spark, geometry.gap(a, c, "y")) == 0.0
    assert one(spark, geometry.near(a, c, 0, 9)) is False
    assert one(spark, geometry.distance(a, c)) == 20.0
    assert one(spark, geometry.from_json(F.lit('{"x0": 1}'))) is None


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, vectors.cosine(a, b)) - 0.5**0.5) < 1e-12
    with pytest.raises(Exception, match="zero vector"):
        one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))))
    with pytest.raises(Exception, match="differ in size"):
        one(spark, vectors.cosine(a, F.array(F.lit(1.0))))


def test_metadata(spark):
    values = F.create_map(F.lit("page_number"), F.lit("3"), F.lit("slide_number"), F.lit("3.7"), F.lit("start_seconds"), F.lit("10"), F.lit("source_type"), F.lit("  pdf "), F.lit("x"), F.lit(" y "))
    assert one(spark, metadata.normalized(values)) == {"page_number": "3", "slide_number": "3.7", "start_seconds": "10.0", "source_type": "pdf", "x": " y "}
    assert one(spark, metadata.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))) == "z"


@pytest.mark.parametrize(
    ("url", "video"),
    [("https://www.youtube.com/watch?v=abc&t=1", "abc"), ("https://youtube.com/shorts/xyz", "xyz"), ("https://youtu.be/q1?x=2", "q1"), ("https://m.youtube.com/watch?v=abc", None), ("not a url", None)],
)
def test_youtube(spark, url, video):
    assert one(spark, paths.youtube_id(F.lit(url))) == video


def test_paths(spark):
    assert one(spark, paths.extension(F.lit("/a.b/c.PDF"))) == ".pdf"
    assert one(spark, paths.extension(F.lit("/a.b/c"))) == ""
    assert one(spark, paths.safe_name(F.lit("../x y?.txt"))) == "x_y_.txt"
    assert one(spark, paths.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000"))) is True
    assert one(spark, paths.is_uuid(F.lit("nope"))) is False
