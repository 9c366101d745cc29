"""Quality rules: plain document statistics and a hashed n-gram likelihood ratio.

Everything runs as DataFrame expressions.  Two multinomials over hashed n-grams
are counted over all documents: one of the trusted target (documents whose label
says good), one of the whole raw corpus.  The n-grams are tokens, which are runs of
letters and digits or runs of other characters, and pairs of neighbouring tokens; each
kind has ``buckets`` hash buckets.  A document's score is its mean log ratio of target
to raw probability over all its n-grams; it is kept if no base rule fails and the score
reaches a fixed threshold.

What goes to the driver are two counts for each of ``2 * buckets`` hash buckets,
however large the corpus.  Counting combines on the map side, so a frequent word
is one partial count in each task.

Hashes: n-grams share buckets by design, and the three-word windows of
``n_repeat_words`` are compared by 64-bit hashes of their words' hashes, inside one
document; equal hashes count as equal windows.

Defined cases: a null text has no words; a text without words fails the base
rule (fewer than 50 words), and one without tokens has score 0; with no trusted
document at all the ratio says nothing, every score is 0 and base rules alone decide;
repeated rows count and are judged each on its own, and so are rows without doc_id,
which are never trusted; a doc_id with several labels is trusted if one says good; an
empty table gives no rows; a very long text is one row of arrays of its own size and is
never cut; a score equal to the threshold keeps the document; columns of any other name
in ``docs`` are ignored unless ``keep`` names them, and then come out as ``kept_<name>``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

BUCKETS = 8192
THRESHOLD = -0.15
SMOOTHING = 1.0
#: Up to so many trusted ids are sent to every executor; more are joined by shuffle.
BROADCAST_IDS = 2_000_000

BLANK = r"[\x20\x09-\x0D]+"
#: Tokens of the likelihood ratio: runs of letters and digits, runs of anything else but white space.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _hashes(items: Column) -> Column:
    return F.transform(items, lambda x: F.xxhash64(x))


def _tokens(text: Column) -> Column:
    """Hashes of a text's tokens in order."""
    return _hashes(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def _grams(tokens: Column, buckets: int) -> Column:
    """Bucket numbers of all n-grams: tokens below ``buckets``, pairs of tokens from there on."""
    single = F.transform(tokens, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    behind = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(tokens, 1, behind), F.slice(tokens, 2, behind),
        lambda a, b: (F.pmod(F.xxhash64(a, b), F.lit(buckets)) + buckets).cast("int"),
    )
    return F.concat(single, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<int>")))


def gram_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of target to raw probability of each bucket, over all documents."""
    trusted = labels.filter(F.col("quality") == 1).select(labels["doc_id"].cast("long").alias("good_id")).distinct()
    if trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    base = texts(docs)
    flagged = base.join(trusted, base["doc_id"] == trusted["good_id"], "left").select(
        F.col("good_id").isNotNull().alias("good"), _tokens(F.col("text")).alias("tokens")
    )
    counted = (
        flagged.select("good", F.explode(_grams(F.col("tokens"), buckets)).alias("gram"))
        .groupBy("gram")
        .agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))
        .collect()
    )
    weights = [0.0] * (2 * buckets)
    for part in (0, 1):
        rows = [r for r in counted if r["gram"] // buckets == part]
        raw, target = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
        if not target:
            continue
        for r in rows:
            p = (r["target"] + SMOOTHING) / (target + SMOOTHING * buckets)
            q = (r["raw"] + SMOOTHING) / (raw + SMOOTHING * buckets)
            weights[r["gram"]] = math.log(p / q)
    return weights


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The base statistics of every document, its tokens besides."""
    base = docs.withColumns({"words": _words(F.col("text")), "tokens": _tokens(F.col("text"))})
    base = base.withColumns({"n_words": F.size("words").cast("long"), "hashes": _hashes(F.col("words"))})
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
            lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("windows", windows)
    # only texts that have a window twice need its places: sorted by (hash, place), equal hashes are neighbours
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    base = base.withColumn("placed", placed)
    n = F.size("placed")
    twice = F.zip_with(
        F.slice("placed", 1, F.greatest(n - 1, F.lit(0))),
        F.slice("placed", 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: F.size(x) > 0))))
    covered = F.aggregate(
        F.when(n > 1, places).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(3), i - a["last"]).cast("bigint")).alias("n"), i.alias("last")
        ),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("lines", lines)
    return base.select(
        *keep, "doc_id", "n_words", "tokens",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def judge(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Statistics, score and verdict of every document; ``keep`` names columns of ``docs`` to carry along."""
    weights = gram_weights(docs, labels, buckets)
    return judge_with(docs, weights, threshold, keep)


def judge_with(docs: DataFrame, weights: list[float], threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`judge` with known weights: one pass without a shuffle."""
    table = F.from_json(F.lit(json.dumps([round(w, 9) for w in weights])), "array<double>")
    clean = docs.select(
        *[docs[c].alias(f"kept_{c}") for c in keep], docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )
    stats = statistics(clean, *[f"kept_{c}" for c in keep])
    stats = stats.withColumn("grams", _grams(F.col("tokens"), len(weights) // 2)).drop("tokens")
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(table, g))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = (
        stats.withColumn("score", F.round(F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0)), 6))
        .drop("grams")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("score") >= threshold))
        .withColumn("ls_row", F.monotonically_increasing_id())
    )
    # a filter on these columns, pushed below the projections that compute them, would compute
    # every statistic again for each use; reading a row number keeps it above them
    names = [c for c in judged.columns if c not in ("ls_row", "doc_id") and not c.startswith("kept_")]
    return judged.select(
        *[c for c in judged.columns if c == "doc_id" or c.startswith("kept_")],
        *[F.when(F.col("ls_row") >= 0, F.col(c)).alias(c) for c in names],
    )


def accepted(judged: DataFrame) -> DataFrame:
    """The rows that are kept."""
    return judged.filter("kept")
