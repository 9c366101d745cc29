"""Text functions: normalisation, hashes, ids, tokens, reference numbers."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, as Python's str.strip() sees it.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: What separates retrieval terms.
NON_TERM = r"[^\p{L}\p{N}]+"


def normalize(text: str) -> str:
    """NFC, LF line ends, no control or unassigned characters, at most one blank line, no outer blanks."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    text = "".join(c for c in text if c in "\n\t" or unicodedata.category(c)[0] != "C")
    text = "\n".join(line.rstrip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _normalize_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(normalize, na_action="ignore")


def normalize_text(text: Column | str) -> Column:
    """:func:`normalize` in Arrow batches; Spark has neither NFC nor Python's categories."""
    return F.pandas_udf(_normalize_batches, "string")(text)


def strip(text: Column) -> Column:
    """Python's ``strip`` without a UDF."""
    return F.regexp_replace(text, EDGES, "")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", document_id, index.cast("string")).cast("binary"), 256)


def canonical_id(document_id: Column, element_id: Column) -> Column:
    return F.concat(document_id, F.lit(":"), element_id)


def terms(text: Column) -> Column:
    """Lower-cased retrieval terms in order."""
    return F.filter(F.split(F.lower(text), NON_TERM), lambda t: t != "")


# How a figure's and a table's number are announced.
FIGURE = r"(?i)\b(?:figure|fig\.)\s+(\d+(?:\.\d+)*)"
TABLE = r"(?i)\btable\s+(\d+(?:\.\d+)*)"


def figure_number(text: Column) -> Column:
    """The number after the first "Figure" or "Fig.", else null."""
    return F.nullif(F.regexp_extract(text, FIGURE, 1), F.lit(""))


def table_number(text: Column) -> Column:
    """The number after the first "Table", else null."""
    return F.nullif(F.regexp_extract(text, TABLE, 1), F.lit(""))


def clean_query(text: Column) -> Column:
    """A rewriter's answer without code fences, outer blanks and one pair of quotes."""
    bare = strip(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*|\s*```$", ""))
    return strip(F.regexp_replace(bare, r"""(?s)^(["'])(.*)\1$""", "$2"))


def formatted_context(items: Column) -> Column:
    """``[1] first`` and so on from an array of contents, blank lines between."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def caption_seconds(stamp: Column) -> Column:
    """Seconds of ``mm:ss.mmm`` or ``hh:mm:ss,mmm``; null if it is neither."""
    parts = F.split(F.regexp_replace(F.trim(stamp), ",", "."), ":")
    n = F.size(parts)
    at = lambda i: F.try_element_at(parts, i).try_cast("double")
    return F.when(n == 3, at(F.lit(1)) * 3600 + at(F.lit(2)) * 60 + at(F.lit(3))).when(n == 2, at(F.lit(1)) * 60 + at(F.lit(2)))


def _named_uuids(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in names:
        yield batch.map(lambda n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)), na_action="ignore")


def point_id(collection: str, chunk: Column) -> Column:
    """A UUID that follows from the chunk id, for stores whose keys must be UUIDs."""
    return F.pandas_udf(_named_uuids, "string")(F.concat(F.lit(f"{collection}:"), chunk))
