"""Sharding by extendible hashing.

A directory maps prefixes of a 60-bit hash to shards.  It starts with one shard;
only a shard that is over its byte limit splits, on the next hash bit, until each
fits.  A document's shard is therefore the shortest prefix of its hash whose
documents fit the limit together.

Sizes are counted for all documents.  One aggregate sums bytes for fine cells of
the hash space; a level-by-level roll-up of those sums tells which prefixes
overflow, which is the directory; cells that are still too large go on, alone,
with their own documents.  Every aggregate combines on the map side, so no task
holds a shard's documents.  Documents whose whole hash collides (repeated rows of
one id) cannot be told apart by bits: from ``MAX_DEPTH`` on, those over half the
limit have a shard each, and a running byte sum cuts the others so that no shard
passes the limit.  These sums run over range partitions, so that one id that a third of
all rows have is summed by many tasks.  A document over the limit has a shard of its own
and is marked.

Defined cases: a null or empty text has 0 bytes and still gets a shard; a null
doc_id hashes by its text; rows that repeat a doc_id share a shard as long as they fit;
a shard of exactly the limit fits; an empty table gives an empty result; texts are only
measured, whatever their length; other columns of ``docs``, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, texts

SHARD_BYTES = 4 << 20
#: Levels that one roll-up handles.
STEP = 10
MAX_DEPTH = 60


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the hash, as a number."""
    return F.expr(f"shiftright(hash, {MAX_DEPTH - depth})") if depth else F.lit(0).cast("bigint")


def hashed(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 digest of the id as text, or of the text's own digest."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(text.cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _pieces(rest: DataFrame, limit: int, depth: int) -> DataFrame:
    """Shards of ``rest(doc_id, n_bytes, hash)``, whose documents of one cell bits do not part."""
    # in order of cell and size; rows that are equal in both are parted by their number
    numbered = rest.withColumns({"cell": _prefix(depth), "row": F.monotonically_increasing_id()})
    ranged = numbered.repartitionByRange("cell", "n_bytes", "row").withColumn("task", F.spark_partition_id())
    big = (F.col("n_bytes") > limit // 2).cast("long")
    stored = materialise(ranged.withColumns({"big": big, "little": F.when(big == 0, F.col("n_bytes")).otherwise(0)}), "shard-ranges")
    sums = stored.groupBy("cell", "task").agg(F.sum("big").alias("bigs"), F.sum("little").alias("littles"), F.max("little").alias("most"))
    whole = Window.partitionBy("cell")  # one row for each task
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "cell", "task", F.coalesce(F.sum("bigs").over(before), F.lit(0)).alias("bigs"), F.sum("bigs").over(whole).alias("all_bigs"),
        F.coalesce(F.sum("littles").over(before), F.lit(0)).alias("littles"), F.max("most").over(whole).alias("most"),
    )
    own = Window.partitionBy("cell", "task").orderBy("n_bytes", "row").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.col(f"{c}s") + F.coalesce(F.sum(c).over(own), F.lit(0))
    joined = stored.join(bases, ["cell", "task"])
    # a piece's rows start within one step of each other, so the last of them still ends within the limit
    nth = F.floor(run("little") / (limit - F.col("most") + 1))
    piece = F.when(F.col("big") == 1, run("big")).otherwise(F.col("all_bigs") + nth)
    return joined.select(
        "doc_id", "n_bytes", F.concat_ws("+", F.lpad(F.bin("cell"), depth, "0"), piece.cast("string")).alias("shard"),
        F.lit(depth).alias("depth"), (F.col("n_bytes") > limit).alias("oversize"),
    )


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, oversize) of every document."""
    base = texts(docs).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        hashed(F.col("doc_id"), F.col("text")).alias("hash"),
    )
    open_docs = materialise(base, "shard-keys")
    done: DataFrame | None = None
    start = 0
    while True:
        last = min(start + STEP, MAX_DEPTH)
        fine = open_docs.groupBy(_prefix(last).alias("cell")).agg(F.sum("n_bytes").alias("size"))
        # one row for each cell and level, summed by prefix: sizes of all prefixes of these levels
        levels = fine.select(
            "size", "cell", F.explode(F.sequence(F.lit(start), F.lit(last))).alias("depth")
        ).select("depth", F.expr(f"shiftright(cell, {last} - depth)").alias("prefix"), "size")
        fits = levels.groupBy("depth", "prefix").agg(F.sum("size").alias("size")).filter(F.col("size") <= limit)
        # the directory: prefixes that fit and whose parents do not
        parents = fits.select((F.col("depth") + 1).alias("depth"), "prefix")
        cells = fits.alias("f").join(
            parents.select(F.col("depth").alias("p_depth"), F.col("prefix").alias("p_prefix")),
            (F.col("f.depth") == F.col("p_depth")) & (F.expr("shiftright(f.prefix, 1)") == F.col("p_prefix")),
            "left_anti",
        )
        directory = materialise(cells.select("depth", "prefix", "size"), "shard-directory")
        depths = [r["depth"] for r in directory.select("depth").distinct().collect()]
        keyed = open_docs.withColumn("keys", F.array(*[
            F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in sorted(depths)
        ] or [F.struct(F.lit(-1).alias("depth"), F.lit(0).cast("bigint").alias("prefix"))]))
        found = (
            keyed.select("doc_id", "n_bytes", "hash", F.explode("keys").alias("k"))
            .join(directory.select(F.col("depth"), F.col("prefix"), F.lit(True).alias("hit")),
                  (F.col("k.depth") == F.col("depth")) & (F.col("k.prefix") == F.col("prefix")))
            .select("doc_id", "n_bytes", "hash", "depth", F.col("prefix").alias("shard_prefix"))
        )
        bits = F.lpad(F.bin("shard_prefix"), F.col("depth"), "0")
        placed = found.select(
            "doc_id", "n_bytes", F.when(F.col("depth") == 0, F.lit("root")).otherwise(bits).alias("shard"),
            F.col("depth").cast("int").alias("depth"), F.lit(False).alias("oversize"),
        )
        done = placed if done is None else done.unionByName(placed)
        # what is left lies in cells of the last level that are still too large
        over = fine.filter(F.col("size") > limit).select(F.col("cell").alias("over_cell"))
        rest = open_docs.join(over, _prefix(last) == F.col("over_cell"), "left_semi")
        rest = materialise(rest, "shard-rest")
        if rest.isEmpty():
            return done
        alone = rest.groupBy(_prefix(last).alias("cell")).agg(F.max("n_bytes").alias("most"), F.count("*").alias("n"))
        if last == MAX_DEPTH or alone.filter(F.col("n") > 1).isEmpty():
            return done.unionByName(_pieces(rest, limit, last))
        open_docs, start = rest, last


def shard_sizes(assigned: DataFrame) -> DataFrame:
    """(shard, depth, n_docs, n_bytes) of every shard."""
    return assigned.groupBy("shard", "depth").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
