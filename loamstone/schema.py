"""Row schemas and closed vocabularies of the document-knowledge model."""

from __future__ import annotations

# Kinds of content, elements, edges, states and roles.
CONTENT_KINDS = ("text", "table", "image", "audio", "video")
ELEMENT_TYPES = (
    "document", "page", "paragraph", "heading", "subtitle", "text", "notes", "image", "table", "link", "chart", "slide",
    "workbook", "sheet", "audio", "transcript", "video", "video_frame", "youtube", "image_semantic",
)
STRONG_EDGES = ("contains", "parent_of", "child_of", "caption_of", "derived_from", "refers_to", "belongs_to")
WEAK_EDGES = ("follows", "precedes", "spatially_adjacent", "temporally_adjacent")
DOCUMENT_STATES = ("pending", "processing", "completed", "failed")
RUN_STATES = ("running", "completed", "failed")
ROLES = ("user", "assistant")

ELEMENTS = (
    "document_id string, element_id string, ordinal int, element_type string, content_kind string, text string, "
    "asset_path string, metadata string"
)
RELATIONSHIPS = (
    "document_id string, rel_ordinal int, source_element_id string, relationship_type string, target_element_id string, metadata string"
)
CHUNKS = "chunk_id string, document_id string, chunk_index int, content string, metadata string"
RESULTS = "query_id string, rank int, chunk_id string, document_id string, chunk_index int, content string, score double"
BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"

#: What a loader returns for one document, before it is exploded into two tables.
LOADED = (
    "elements array<struct<element_id:string,element_type:string,content_kind:string,text:string,asset_path:string,metadata:string>>, "
    "edges array<struct<source:string,type:string,target:string,metadata:string>>, error string"
)
