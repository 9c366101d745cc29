"""Relationship-aware chunking: recursive splitting, group packing, chunk metadata.

A document is the unit of work: its elements with their groups and its edges meet in one
``applyInPandas`` call, as order, packing and indices are sequential inside it.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..schema import CHUNKS, STRONG_EDGES

SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, which stays at the start of what follows."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _windows(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    """Greedy windows of whole pieces; a window starts with the tail of the one before."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        out.append("".join(held))
    return [x for x in map(str.strip, out) if x]


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the strongest separator that serves."""
    if len(text) <= size:
        return [text]
    return _split(text, size, overlap, separators)


def _split(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    weaker = separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += _windows(small, size, overlap)
        small = []
        if weaker:
            out += _split(piece, size, overlap, weaker)
        else:
            out += [piece.strip()] if piece.strip() else []
    return out + _windows(small, size, overlap)


def components(ids: Sequence[str], edges: Sequence[tuple[str, str]]) -> list[list[str]]:
    """Connected components among ``ids``, by first member, members in given order."""
    parent = {i: i for i in ids}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = {x: n for n, x in enumerate(ids)}
    for a, b in edges:
        if a in parent and b in parent:
            x, y = root(a), root(b)
            if x != y:
                low, high = sorted((x, y), key=order.__getitem__)
                parent[high] = low
    members: dict[str, list[str]] = defaultdict(list)
    for i in ids:
        members[root(i)].append(i)
    return list(members.values())


def pack(members: Sequence[tuple[str, str]], size: int, overlap: int) -> list[tuple[str, list[str], dict]]:
    """(content, element ids, split fields) for a group's (id, text) members in order."""
    out: list[tuple[str, list[str], dict]] = []
    texts: list[str] = []
    ids: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal texts, ids, held
        if texts:
            out.append(("\n\n".join(texts), ids, {}))
        texts, ids, held = [], [], 0

    for element, raw in members:
        text = raw.strip()
        if not text:
            continue
        if len(text) > size:
            flush()
            parts = split_text(text, size, overlap)
            for n, part in enumerate(parts):
                out.append((part, [element], {"split_from_element": True, "split_index": n, "split_count": len(parts)}))
            continue
        if texts and held + 2 + len(text) > size:
            flush()
        held += len(text) + (2 if texts else 0)
        texts.append(text)
        ids.append(element)
    flush()
    return out


def promoted(metadata: Sequence[dict]) -> dict:
    """Keys on whose value all elements that have the key agree."""
    values: dict[str, dict[str, object]] = defaultdict(dict)
    for m in metadata:
        for k, v in m.items():
            values[k][json.dumps(v, sort_keys=True)] = v
    return {k: next(iter(v.values())) for k, v in values.items() if len(v) == 1}


def agreed(rows: DataFrame, *groups: str) -> DataFrame:
    """(groups, key, value) of ``rows(groups, key, value)``: the same rule over tables, missing values aside."""
    found = rows.filter("value is not null").groupBy(*groups, "key").agg(F.min("value").alias("value"), F.max("value").alias("top"))
    return found.filter("value = top").drop("top")


def chunk_one(document_id: str, elements: list[dict], edges: list[dict], size: int, overlap: int) -> list[tuple]:
    """Chunk rows of one document."""
    chunkable = {e["element_id"]: e for e in elements if e["content_kind"] in ("text", "table")}
    strong = [(e["source"], e["target"]) for e in edges if e["type"] in STRONG_EDGES]
    touching: dict[str, list[int]] = defaultdict(list)
    for n, e in enumerate(edges):
        for end in {e["source"], e["target"]}:
            touching[end].append(n)
    out: list[tuple] = []
    qualified = lambda x: f"{document_id}:{x}"
    for group in components(list(chunkable), strong):
        for content, ids, fields in pack([(i, chunkable[i]["text"] or "") for i in group], size, overlap):
            own = [edges[n] for n in sorted({n for i in ids for n in touching[i]})]
            related = {end for e in own for end in (e["source"], e["target"])} - set(ids)
            meta = {
                "element_ids": [qualified(i) for i in ids],
                "element_types": [chunkable[i]["element_type"] for i in ids],
                "relationships": [{"source_element_id": qualified(e["source"]), "relationship_type": e["type"], "target_element_id": qualified(e["target"])} for e in own],
                "related_element_ids": sorted(map(qualified, related)),
                **fields,
            }
            meta |= promoted([json.loads(chunkable[i]["metadata"] or "{}") for i in ids])
            index = len(out)
            key = hashlib.sha256(f"{document_id}:{index}".encode()).hexdigest()
            out.append((key, document_id, index, content, json.dumps(meta, sort_keys=True, ensure_ascii=False)))
    return out


def chunk_documents(elements: DataFrame, relationships: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks of every document: connected elements together, at most ``size`` characters each."""
    if size <= 0:
        raise InvalidArgument("chunk size must be positive")
    if not 0 <= overlap < size:
        raise InvalidArgument("overlap must be at least 0 and less than the chunk size")
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def work(key: tuple, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        items = own.sort_values("ordinal").to_dict("records")
        links = edges.sort_values("rel_ordinal").to_dict("records")
        return pd.DataFrame(chunk_one(key[0], items, links, size, overlap), columns=names)

    left = elements.select("document_id", "element_id", "ordinal", "element_type", "content_kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))
    right = relationships.select(F.col("document_id").alias("document_id"), "rel_ordinal", F.col("source_element_id").alias("source"), F.col("relationship_type").alias("type"), F.col("target_element_id").alias("target"))
    return left.groupBy("document_id").cogroup(right.groupBy("document_id")).applyInPandas(work, CHUNKS)


def split_column(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Pieces of a text column, in Arrow batches."""

    def work(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: split_text((t or "").strip(), size, overlap))

    return F.pandas_udf(work, "array<string>")(text)
