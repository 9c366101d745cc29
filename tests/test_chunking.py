import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.errors import InvalidArgument
from loamstone.operators import chunking

TEXTS = st.text(alphabet="ab .?!\n", max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(2, 60), st.integers(0, 20))
def test_split_bounds(text, size, overlap):
    pieces = chunking.split_text(text, size, min(overlap, size - 1))
    if len(text) > size:
        assert all(0 < len(p) <= size for p in pieces)
        left = "".join(text.split())
        assert set("".join(pieces).split()) <= set(text.split()) or left
        for c in set(left):
            assert sum(p.count(c) for p in pieces) >= left.count(c)


def test_split_examples():
    text = "One sentence here. Another sentence here. A third one now. And the last."
    pieces = chunking.split_text(text, 45, 0)
    assert len(pieces) > 1
    assert all(len(p) <= 45 for p in pieces)
    assert chunking.split_text("short", 10, 0) == ["short"]
    assert chunking.split_text("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]


def element(i, text, kind="text", **meta):
    return {"element_id": i, "element_type": "paragraph", "content_kind": kind, "text": text, "metadata": json.dumps(meta)}


def edge(a, kind, b):
    return {"source": a, "type": kind, "target": b}


def chunk(elements, edges, size=100, overlap=0):
    return chunking.chunk_one("document-1", elements, edges, size, overlap)


def test_strong_edge_groups():
    rows = chunk([element("h", "Head"), element("p", "Body")], [edge("h", "parent_of", "p")])
    assert [r[3] for r in rows] == ["Head\n\nBody"]
    assert json.loads(rows[0][4])["element_ids"] == ["document-1:h", "document-1:p"]


def test_weak_edge_does_not_group_but_is_told():
    rows = chunk([element("a", "x"), element("b", "y")], [edge("a", "spatially_adjacent", "b")])
    assert [r[3] for r in rows] == ["x", "y"]
    assert json.loads(rows[0][4])["related_element_ids"] == ["document-1:b"]
    assert [r[2] for r in rows] == [0, 1]


def test_image_is_related_not_traversed():
    items = [element("a", "x"), element("i", None, "image"), element("b", "y")]
    rows = chunk(items, [edge("a", "refers_to", "i"), edge("b", "refers_to", "i")])
    assert len(rows) == 2
    assert json.loads(rows[0][4])["related_element_ids"] == ["document-1:i"]


def test_oversize_element_flushes():
    rows = chunk([element("a", "aa"), element("b", "word " * 40), element("c", "cc")], [edge("a", "contains", "b"), edge("b", "contains", "c")], 50)
    assert rows[0][3] == "aa"
    assert rows[-1][3] == "cc"
    middle = [json.loads(r[4]) for r in rows[1:-1]]
    assert [m["split_index"] for m in middle] == list(range(len(middle)))
    assert all(m["split_count"] == len(middle) and m["split_from_element"] for m in middle)


def test_packing_counts_separators():
    items = [element(str(n), "x" * 10) for n in range(3)]
    rows = chunk(items, [edge("0", "contains", "1"), edge("1", "contains", "2")], 22)
    assert [len(r[3]) for r in rows] == [22, 10]


def test_promotion_of_agreed_keys():
    assert chunking.promoted([{"page": 1, "x": 1}, {"page": 1, "x": 2}, {"y": {"a": 1}}]) == {"page": 1, "y": {"a": 1}}


def test_arguments(spark):
    e = spark.createDataFrame([], "document_id string, element_id string, ordinal int, element_type string, content_kind string, text string, metadata string")
    r = spark.createDataFrame([], "document_id string, rel_ordinal int, source_element_id string, relationship_type string, target_element_id string")
    with pytest.raises(InvalidArgument):
        chunking.chunk_documents(e, r, 0)
    with pytest.raises(InvalidArgument):
        chunking.chunk_documents(e, r, 10, 10)
    assert chunking.chunk_documents(e, r).count() == 0


def test_many_documents(spark):
    e = spark.createDataFrame([(f"d{d}", str(n), n, "paragraph", "text", f"text {n}", "{}") for d in range(5) for n in range(4)],
                              "document_id string, element_id string, ordinal int, element_type string, content_kind string, text string, metadata string")
    r = spark.createDataFrame([(f"d{d}", 0, "0", "contains", "3") for d in range(5)], "document_id string, rel_ordinal int, source_element_id string, relationship_type string, target_element_id string")
    rows = chunking.chunk_documents(e, r).collect()
    assert len(rows) == 15
    assert sorted(x["content"] for x in rows if x["document_id"] == "d0") == ["text 0\n\ntext 3", "text 1", "text 2"]
