"""License scan: Aho-Corasick for tags and notices, shunting-yard for expressions.

One pass over whole texts.  Each text is reduced to its words (A-Z lowered,
words are runs of ASCII letters, digits and non-ASCII characters), and one
Aho-Corasick automaton over the space-joined words reports every place of every
notice phrase, overlapping ones included.  A second automaton over the raw text
finds identifier tags; what follows a tag is read as a licence expression by a
shunting-yard parser (``with`` binds tighter than ``and``, ``and`` than ``or``).

A text is ``permissive`` if every expression can be met with permissive licences and
every label that no expression names is permissive; null without any label.

Defined cases: a null text is empty; empty text has no words, no places, empty
label strings and score 0; repeated rows, and rows without doc_id, are scanned each on
its own; a tag with a malformed expression contributes the licence names it can read and
lowers the score; a phrase that ends where another one begins counts as well as that one;
an empty table gives no rows; very long texts are scanned whole, by one task each; other
columns of ``docs``, whatever their names, are ignored.  Rows are independent, so nothing
is shuffled and no key can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_TABLE, chunks, map_arrow, texts

# The phrases every scan reports, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc0": "cc0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "all rights reserved": "proprietary",
    "released into the public domain": "public-domain",
}

# Tags that announce a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:")

# Licence families by identifier prefix, the longest prefix wins.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd",
    "mpl": "mpl", "epl": "epl", "isc": "isc", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa", "cc0": "cc0", "unlicense": "public-domain", "zlib": "zlib",
}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, n_notices long, expressions array<string>, permissive boolean"
)

#: Families whose terms ask for no source disclosure.
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "zlib", "cc0", "public-domain", "cc-by"})


def family(identifier: str) -> str | None:
    """The family label of a licence identifier, or None if it names no known one."""
    low = identifier.lower().rstrip("+")
    best = max((p for p in FAMILIES if low == p or low.startswith(p + "-")), key=len, default=None)
    return FAMILIES[best] if best else None


def parse_expression(text: str) -> tuple[list, list[str]]:
    """Shunting-yard over ``a AND (b OR c) WITH d``: reverse Polish output, and what was wrong."""
    output: list = []
    operators: list[str] = []
    faults: list[str] = []
    operand = False
    for token in re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", text):
        low = token.lower()
        if token == "(":
            if operand:
                break  # prose goes on after a whole expression
            operators.append(token)
        elif token == ")":
            if not operand:
                faults.append("empty group")
            while operators and operators[-1] != "(":
                output.append(operators.pop())
            if not operators:
                break
            operators.pop()
        elif low in PRECEDENCE:
            if not operand:
                faults.append(f"{low} lacks an operand")
                break
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[low]:
                output.append(operators.pop())
            operators.append(low)
            operand = False
        else:
            if operand:
                break
            output.append(token)
            operand = True
    if not operand and output:
        faults.append("ends in an operator")
    while operators:
        op = operators.pop()
        if op == "(":
            faults.append("unclosed group")
        else:
            output.append(op)
    return output, faults


def evaluate(rpn: list, allowed: frozenset[str] = PERMISSIVE) -> bool:
    """Whether the expression can be met with licences of ``allowed`` families only."""
    stack: list[bool] = []
    for token in rpn:
        low = token.lower()
        if low in PRECEDENCE:
            if len(stack) < 2:
                continue
            right, left = stack.pop(), stack.pop()
            stack.append(left if low == "with" else left and right if low == "and" else left or right)
        else:
            stack.append(family(token) in allowed)
    return bool(stack) and all(stack)


def names(rpn: list) -> list[str]:
    """Labels of the licences that an expression names; an exception after ``with`` is none."""
    stack: list[list[str]] = []
    for token in rpn:
        low = token.lower()
        if low in PRECEDENCE:
            if len(stack) >= 2:
                right, left = stack.pop(), stack.pop()
                stack.append(left if low == "with" else left + right)
        else:
            label = family(token)
            stack.append([label] if label else [])
    return [x for part in stack for x in part]


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """The word-phrase automaton and the tag automaton, built once in each worker."""
    phrases = ahocorasick.Automaton()
    for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES}.items():
        phrases.add_word(f" {phrase} ", (label, phrase in BASE_PHRASES, len(phrase) + 1))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str) -> tuple:
    """One row of the scan, without doc_id."""
    phrases, tags = automata()
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_TABLE).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    base: set[str] = set()
    extra: set[str] = set()
    n_base = n_notices = 0
    first = last = None
    seen, at = 0, 0
    for end, (label, is_base, back) in sorted(phrases.iter(joined), key=lambda hit: hit[0] - hit[1][2]):
        if not is_base:
            n_notices += 1
            extra.add(label)
            continue
        start = end - back  # the blank before the phrase: as many blanks lie before it as words
        seen += joined.count(" ", at, start)
        at = start
        n_base += 1
        base.add(label)
        first = seen if first is None else first
        last = seen
    low = raw.lower().decode("latin-1")
    expressions: list[str] = []
    named: set[str] = set()
    faults = 0
    verdicts: list[bool] = []
    if ":" in low:
        for end, _ in tags.iter(low):
            line = raw[end + 1 :].split(b"\n", 1)[0].decode("utf-8", "replace")
            rpn, wrong = parse_expression(line)
            faults += bool(wrong)
            if rpn:
                expressions.append(" ".join(rpn))
                named.update(names(rpn))
                verdicts.append(evaluate(rpn))
    every = base | extra | named
    evidence = n_base + n_notices + 2 * len(expressions)
    score = evidence / (evidence + 1.0) / (1.0 + faults) if every else 0.0
    permissive = all(verdicts) and every - named <= PERMISSIVE if verdicts or every else None
    return (
        len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(every)), score,
        n_notices, expressions, permissive,
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("n_notices", pa.int64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_()),
    ])
    for batch in chunks(batches):
        rows = [scan_text(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id").to_pylist(), *zip(*rows, strict=True)]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence findings of every document; see the module for the rules."""
    return map_arrow(texts(docs), _scan, SCHEMA)
