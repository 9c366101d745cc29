"""Benchmark decontamination over a positional inverted index.

All steps are DataFrame operations.  The index holds postings (document, place)
of every training token that any benchmark text uses, in document shards, sorted
by term inside each shard, so that a term's list is contiguous and the readers'
statistics skip the others.  A benchmark text asks for each run of ``window``
consecutive words (a shorter text asks for itself).  A run is looked up from its
rarest term: that list, moved by the term's offset, gives candidate starts; the
lists of the second and third rarest terms, moved alike, are intersected with
them; what is left is checked against all its terms' lists.

Lists are intersected by joins keyed by (document, place, term), so neither a passage
that a third of all documents share nor a frequent word makes a hot key there, and
frequent words' lists are only read for documents that are still candidates.  What the
benchmark has (its vocabulary, its windows) is broadcast up to a checked number of rows;
beyond it, :func:`lookup` deals the postings of each term over ``PARTS`` tasks and sends
the benchmark's rows to each, so that a frequent term is no hot key either.

Defined cases: null or empty texts have no words, no hits and are clean; rows
that repeat a doc_id, or have none, are judged each on its own; benchmark rows that
repeat an item_id are one item; an item without an id hits words but is not listed; a
benchmark without words leaves everything clean; an empty table gives no rows; terms of
equal frequency are ranked by their hash; a document with 20 times as many words as hits
is contaminated; very long texts are cut into words whole, by one task each; other
columns of ``docs``, whatever their names, are ignored.  Terms stand as 64-bit hashes in
the index: two words of the benchmark's vocabulary with one hash would count as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_WORD, lookup, mark, materialise, small, texts

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words of the token contract: A-Z lowered, runs of digits, a-z and non-ASCII characters."""
    # lower() would change letters beyond A-Z too, but an ASCII text has none
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, f"[{NON_WORD}]+"), "")


@dataclass
class PositionalIndex:
    """postings(rid, pos, term) and lengths(rid, doc_id, mark, n_words), both on disk."""

    postings: DataFrame
    lengths: DataFrame


def build_index(docs: DataFrame, vocabulary: DataFrame) -> PositionalIndex:
    """Postings of all places in ``docs`` where a word of ``vocabulary(word)`` stands."""
    base = texts(docs).withColumns({"rid": F.monotonically_increasing_id(), "mark": mark(F.col("text"))})
    # one extra place behind the last word carries the length, so one pass yields both parts
    ended = base.select("rid", "doc_id", "mark", F.concat(tokens(F.col("text")), F.array(F.lit(None).cast("string"))).alias("w"))
    placed = ended.select("rid", "doc_id", "mark", F.posexplode("w").alias("pos", "word"))
    terms = vocabulary.select("word", F.xxhash64("word").alias("term")).distinct()
    rows = lookup(placed, terms, ["word"], ["rid", "pos"], "left").filter(F.col("term").isNotNull() | F.col("word").isNull())
    stored = materialise(
        rows.select(
            F.when(F.col("word").isNull(), F.col("doc_id")).alias("doc_id"),
            F.when(F.col("word").isNull(), F.col("mark")).alias("mark"), "rid", "pos", "term",
            F.col("word").isNull().alias("is_end"),
        ).sortWithinPartitions("term", "rid", "pos"),
        "postings",
    )
    return PositionalIndex(
        stored.filter(~F.col("is_end")).select("rid", "pos", "term"),
        stored.filter("is_end").select("rid", "doc_id", "mark", F.col("pos").cast("long").alias("n_words")),
    )


def benchmark_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(item, row, q, word, size): every word of every benchmark text with its place."""
    base = items.select(F.col(key).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = base.distinct().select("item", F.xxhash64("item", "text").alias("row"), tokens(F.col("text")).alias("w"))
    return words.select("item", "row", F.size("w").alias("size"), F.posexplode("w").alias("q", "word"))


def ranked_windows(asked: DataFrame, index: PositionalIndex, window: int = WINDOW) -> DataFrame:
    """(row, s, off, term, width, rank): terms of each window, the rarest in the index first."""
    used = index.postings.groupBy("term").agg(F.count("*").alias("uses"))
    starts = asked.withColumn(
        "s",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - (window - 1)),
                             F.greatest(F.lit(0), F.least(F.col("q"), F.col("size") - window)))),
    )
    terms = starts.select(
        "row", "s", (F.col("q") - F.col("s")).alias("off"), F.xxhash64("word").alias("term"),
        F.least(F.col("size"), F.lit(window)).alias("width"),
    )
    known = terms.join(used, "term")
    whole = F.count("*").over(Window.partitionBy("row", "s"))
    order = Window.partitionBy("row", "s").orderBy("uses", "term", "off")
    # a window with a term that no document has cannot occur
    return known.withColumn("found", whole).filter("found = width").withColumn("rank", F.row_number().over(order))


def phrase_matches(index: PositionalIndex, windows: DataFrame) -> DataFrame:
    """(row, s, rid, start, width): every place where a whole window stands."""
    lists = index.postings
    first = windows.filter("rank = 1").select("row", "s", "off", "term", "width")
    found = lookup(lists, first, ["term"], ["rid", "pos"]).select("row", "s", "width", "rid", (F.col("pos") - F.col("off")).alias("start"))
    found = found.filter("start >= 0")
    for rank in (2, 3):
        nth = windows.filter(F.col("rank") == rank)
        terms = nth.select("row", "s", F.col("off").alias("n_off"), F.col("term").alias("n_term"))
        probe = lookup(found, terms, ["row", "s"], ["rid", "start"], "left").withColumn("n_pos", F.col("start") + F.col("n_off"))
        own = lookup(lists, nth.select("term").distinct(), ["term"], ["rid", "pos"], "left_semi").select(
            F.col("rid").alias("o_rid"), F.col("pos").alias("o_pos"), F.col("term").alias("o_term")
        )
        longer = probe.filter("n_term is not null").join(
            own, (F.col("rid") == F.col("o_rid")) & (F.col("n_pos") == F.col("o_pos")) & (F.col("n_term") == F.col("o_term")),
            "left_semi",
        )
        found = longer.unionByName(probe.filter("n_term is null")).select("row", "s", "width", "rid", "start")
    found = materialise(found, "candidates")
    left = small(found.select("rid").distinct())
    rest = lists.join(left, "rid", "left_semi").select(
        F.col("rid").alias("o_rid"), F.col("pos").alias("o_pos"), F.col("term").alias("o_term")
    )
    every = lookup(found, windows.select("row", "s", "off", "term"), ["row", "s"], ["rid", "start"]).withColumn(
        "n_pos", F.col("start") + F.col("off")
    )
    return (
        every.join(rest, (F.col("rid") == F.col("o_rid")) & (F.col("n_pos") == F.col("o_pos")) & (F.col("term") == F.col("o_term")))
        .groupBy("row", "s", "rid", "start", "width")
        .agg(F.count("*").alias("hits"))
        .filter("hits = width")
        .drop("hits")
    )


def proximity_matches(index: PositionalIndex, windows: DataFrame, span: int, terms: int = 3) -> DataFrame:
    """(row, s, rid, near): windows whose ``terms`` rarest terms stand within ``span`` words of the rarest one.

    ``near`` counts places of the rarest term that have all the others close by.
    """
    lists = index.postings
    first = windows.filter("rank = 1").select("row", "s", "term", "width")
    found = lookup(lists, first, ["term"], ["rid", "pos"]).select("row", "s", "width", "rid", F.col("pos").alias("at"))
    for rank in range(2, terms + 1):
        nth = windows.filter(F.col("rank") == rank).select("row", "s", F.col("term").alias("n_term"))
        # places are cut into blocks of span words: what is near lies in the same or the next block
        probe = lookup(found, nth, ["row", "s"], ["rid", "at"]).withColumn(
            "block", F.explode(F.sequence(F.floor((F.col("at") - span) / span), F.floor((F.col("at") + span) / span)))
        )
        own = lookup(lists, nth.select(F.col("n_term").alias("term")).distinct(), ["term"], ["rid", "pos"], "left_semi").select(
            F.col("rid").alias("o_rid"), F.col("pos").alias("o_pos"), F.col("term").alias("o_term"),
            F.floor(F.col("pos") / span).alias("o_block"),
        )
        found = probe.join(
            own,
            (F.col("rid") == F.col("o_rid")) & (F.col("block") == F.col("o_block")) & (F.col("n_term") == F.col("o_term"))
            & (F.abs(F.col("at") - F.col("o_pos")) <= span),
            "left_semi",
        ).select("row", "s", "width", "rid", "at").distinct()
    return found.groupBy("row", "s", "rid").agg(F.count("*").alias("near"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    return marked_contamination(docs, items, window).drop("mark")


def marked_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """:func:`contamination` with ``mark``, which tells rows of one doc_id apart by text."""
    asked = materialise(benchmark_terms(items), "benchmark-terms")
    index = build_index(docs, asked.select("word"))
    windows = materialise(ranked_windows(asked, index, window), "windows")
    matches = materialise(phrase_matches(index, windows), "matches")
    places = matches.select("rid", "start", "width").distinct()
    hit = (
        places.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("pos"))
        .distinct()
        .groupBy("rid")
        .agg(F.count("*").alias("n_hit"))
    )
    named = asked.select("row", F.col("item").cast("string").alias("item")).distinct()
    listed = (
        matches.select("row", "rid").distinct().join(small(named), "row").groupBy("rid")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    hits = hit.join(listed, "rid", "left")
    items_text = F.coalesce(F.array_join("items", ","), F.lit(""))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0))
    return index.lengths.join(hits, "rid", "left").select(
        "doc_id", "mark", "n_words", n_hit.cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(items_text.cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
